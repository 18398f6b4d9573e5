"""Packing documents into sequences: shortest-pack-first over the length histogram.

1. Documents become ids (one end id each) and are cut into full pieces of
   ``size`` tokens and a rest; a piece's length and checksum are written.
2. The histogram of the piece lengths (at most ``size`` bins) goes to the
   driver.  Lengths are placed longest first: into the open pattern that
   leaves the least room, as many copies as both sides have, else into a new
   pattern.  Patterns carry counts, so the work follows the distinct lengths,
   not the documents.
3. Documents meet their patterns by rank: the k-th piece of a length takes the
   k-th place that the patterns offer for that length.  Ranks come from counts
   by task and length, so no task numbers a whole length.

A sequence whose tokens are a power of two needs no padding; all others are
padded to ``size``.

Edge cases: null text counts as empty and is one end id; repeated rows and
null doc_ids are packed row by row; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from defectlens.llm.common import in_arrow, staged, text_or_empty
from defectlens.llm.tokens import encoder, with_end

SIZE = 4096
PIECES = ("doc_id bigint, start bigint, length int, ids_crc32 bigint, doc_tokens bigint, part int, rank bigint")


def token_pieces(docs: DataFrame, path: str, cut: str, end_id: int, size: int, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``size`` ids with their rank among equal lengths of the task."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, part, seen = encoder(path, cut), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for b in batches:
            ids, offsets = with_end(*lib.encode(b.column("text")), end_id)
            n = np.diff(offsets)
            parts = (n + size - 1) // size
            doc = np.repeat(np.arange(len(n)), parts)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * size
            length = np.minimum(n[doc] - start, size)
            first = offsets[:-1][doc] + start
            data = memoryview(ids.astype("<u4").tobytes())
            cuts = [(4 * int(a), 4 * int(a + k)) for a, k in zip(first, length)]
            crc = [zlib.crc32(data[a:z]) for a, z in cuts]
            rank = np.empty(len(doc), np.int64)
            order = np.argsort(length, kind="stable")
            sizes, at = np.unique(length[order], return_index=True)
            count = np.diff(np.append(at, len(order)))
            rank[order] = np.arange(len(order)) - np.repeat(at, count) + np.repeat(seen[sizes], count)
            seen[sizes] += count
            arrays = [b.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(crc, pa.int64()),
                      pa.array(n[doc]), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"]
            if keep_ids:
                arrays.append(pa.array([bytes(data[a:z]) for a, z in cuts], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return in_arrow(source, pieces, PIECES + (", ids binary" if keep_ids else ""))


def pack_histogram(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, count) of each packing pattern for a histogram of lengths.

    Open patterns are kept by the room they leave; the shortest pack, the one
    with the most room, takes the next length if it fits.
    """
    rooms: list[int] = []  # the distinct rooms of the open patterns, ascending
    open_: dict[int, list[list]] = {}
    full: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], room: int, count: int) -> None:
        if room == 0:
            full.append((pattern, count))
        else:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append([pattern, count])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or rooms[-1] < length:
                fits = size // length  # as many copies of the length as a pack holds
                whole, rest = divmod(left, fits)
                if whole:
                    put((length,) * fits, size - fits * length, whole)
                if rest:
                    put((length,) * rest, size - rest * length, 1)
                break
            room = rooms[-1]
            pattern, count = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[-1]
            n = min(left, count)
            left -= n
            if count > n:
                put(pattern, room, count - n)
            put((*pattern, length), room - length, n)
    return full + [(p, c) for room in rooms for p, c in open_[room]]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length rows (first rank, first sequence, offset) of its places, by rank."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rank = ranks.get(length, 0)
            out.setdefault(length, []).append((rank, sequence, offset))
            ranks[length] = rank + count
            offset += length
        sequence += count
    return {k: np.array(v, np.int64) for k, v in out.items()}


def assign(pieces: DataFrame, size: int) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    counts = pieces.groupBy("part", "length").agg((F.max("rank") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = staged(counts.withColumn("before", before), "pack-ranks")
    histogram = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    table = places(pack_histogram(histogram, size))
    # a sorted merge at every size: the offsets grow with the tasks
    ranked = pieces.hint("merge").join(offsets.select("part", "length", "before"), ["part", "length"]).select(
        *[c for c in pieces.columns if c not in ("part", "rank")], (F.col("before") + F.col("rank")).alias("rank"))
    names = [c for c in ranked.columns if c != "rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length).tolist():
                mine, rows = np.flatnonzero(length == k), table[k]
                row = rows[np.searchsorted(rows[:, 0], rank[mine], side="right") - 1]
                sequence[mine], offset[mine] = row[:, 1] + rank[mine] - row[:, 0], row[:, 2]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return in_arrow(ranked, place, fields + ", sequence_id bigint, offset bigint")


def pack(docs: DataFrame, path: str, cut: str = "blank", end_id: int = 2, size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """One row a piece: where it comes from and where it goes."""
    pieces = staged(token_pieces(docs, path, cut, end_id, size, keep_ids), "pack-pieces")
    return assign(pieces, size).withColumn("length", F.col("length").cast("long"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the pieces of ``pack(..., keep_ids=True)`` joined, not yet padded.

    A group holds one sequence, at most ``size`` ids.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def packing_report(docs: DataFrame, path: str) -> DataFrame:
    return pack(docs, path).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
