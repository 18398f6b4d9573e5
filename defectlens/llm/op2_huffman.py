"""Token-id output: canonical length-limited Huffman coding in independent blocks.

1. Documents are dealt out by ranges of doc_id and encoded to ids in that
   order (one end id after each text); the ids are written once.
2. Counts of the ids over all documents give the code lengths (package-merge,
   at most ``MAX_BITS`` bits); only the lengths are stored, beside the blocks,
   as the codes are canonical: by length, then id.
3. Blocks of whole documents, about ``BLOCK_IDS`` ids each, are packed bit by
   bit.  A block is a row of the output files and can be read alone: its
   place, its documents, its first start, the bit offset of every
   ``STEP``-th id, and the bits.
4. Reading back decodes all checkpoints of a block side by side through one
   table indexed by the next ``MAX_BITS`` bits, ``SECTION`` checkpoints at a
   time.  It needs the folder alone, in any session.

On the driver: the counts by id (bounded by the vocabulary) and the ids of
each range (one number a partition).

Edge cases: null text counts as empty and still has its end id; null doc_ids
come first; equal doc_ids stay neighbours, ordered by a hash of their text;
an empty table gives empty files and an empty result; other columns are not
read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defectlens.llm.common import in_arrow, staged, text_or_empty, wide_parallelism
from defectlens.llm.tokens import encoder, with_end
from defectlens.session import scratch_path

MAX_BITS = 18
BLOCK_IDS = 1 << 17
STEP = 128
SECTION = 1 << 14
IDS_SCHEMA = "doc_id bigint, part int, seq bigint, at bigint, n bigint, ids binary"
BLOCK_SCHEMA = ("part int, block int, start bigint, n_ids bigint, doc_ids array<bigint>, doc_sizes array<bigint>, "
                "checkpoints binary, bits binary")
LENGTHS_SCHEMA = "id int, bits int"


def binary_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Slices [offsets[i], offsets[i + 1]) of an array as binary values."""
    at = (offsets * data.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])


def binary_values(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column one after another, and their offsets in them."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    size = np.dtype(dtype).itemsize
    if not len(column) or offsets[0] == offsets[-1]:
        return np.zeros(0, dtype), offsets - offsets[:1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data.view(dtype), (offsets - offsets[0]) // size


def token_ids(docs: DataFrame, path: str, cut: str, end_id: int) -> DataFrame:
    """Ids per document, in ascending doc_id order by (part, seq)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    tie = F.xxhash64("text")
    ordered = (source.repartitionByRange(wide_parallelism(docs.sparkSession), F.col("doc_id").asc_nulls_first(), tie)
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, at = TaskContext.get().partitionId(), 0, 0
        lib = encoder(path, cut)
        for b in batches:
            ids, offsets = with_end(*lib.encode(b.column("text")), end_id)
            n = np.diff(offsets)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(seq + np.arange(len(n))),
                pa.array(at + offsets[:-1]), pa.array(n), binary_column(ids.astype(lib.dtype), offsets)],
                ["doc_id", "part", "seq", "at", "n", "ids"])
            seq, at = seq + len(n), at + int(offsets[-1])

    return in_arrow(ordered, encode, IDS_SCHEMA, rows=3000)


def id_counts(ids: DataFrame, dtype: str) -> DataFrame:
    """(id, n) over all documents; each task sends one row an id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            found = np.bincount(binary_values(b.column("ids"), dtype)[0])
            if len(found) > len(total):
                total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
            total[:len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["id", "n"])

    return in_arrow(ids.select("ids"), count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal lengths of at most ``limit`` bits for each symbol (0: not used).

    Package-merge: ``limit`` times, pair the cheapest items of the level below
    and merge the pairs with the leaves; a symbol's length is how many of the
    chosen items hold its leaf.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, cost = [], leaves
    for _ in range(limit):
        is_leaf = None
        if levels:
            pairs = cost[: len(cost) // 2 * 2].reshape(-1, 2).sum(axis=1)
            both = np.concatenate([leaves, pairs])
            rank = np.argsort(both, kind="stable")
            cost, is_leaf = both[rank], rank < len(leaves)
        else:
            is_leaf = np.ones(len(leaves), bool)
        levels.append(is_leaf)
    depth = np.zeros(len(leaves), np.int64)
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        chosen = is_leaf[:take]
        own = int(chosen.sum())
        depth[:own] += 1
        take = 2 * (len(chosen) - own)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, symbol), left-aligned in their own lengths."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    step = np.left_shift(np.int64(1), MAX_BITS - size)  # each code's share of all MAX_BITS-bit strings
    codes[order] = (np.cumsum(step) - step) >> (MAX_BITS - size)
    return codes


def decode_table(lengths: np.ndarray) -> np.ndarray:
    """Symbol * 32 + length for each value of the next ``MAX_BITS`` bits."""
    table = np.ones(1 << MAX_BITS, np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    step = np.left_shift(np.int64(1), MAX_BITS - lengths[order].astype(np.int64))
    table[:int(step.sum())] = np.repeat(order.astype(np.uint32) * np.uint32(32) + lengths[order], step)
    return table


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids' codes one after another, and the bit offset of every STEP-th id."""
    if not len(ids):
        return b"", np.zeros(0, np.uint64)
    size = lengths.astype(np.uint64)[ids]
    at = np.cumsum(size) - size
    word = at >> np.uint64(5)
    # codes at the upper end of 64 bits, moved to their place in the word
    upper = codes.astype(np.uint64) << (np.uint64(64) - np.maximum(lengths, 1).astype(np.uint64))
    shifted = upper[ids] >> (at & np.uint64(31))
    # codes are shorter than 32 bits, so one begins in every word; their bits are disjoint, so sums are unions
    begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    total = np.zeros(len(begin) + 1, np.uint64)
    total[:-1] = np.add.reduceat(shifted >> np.uint64(32), begin)
    total[1:] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), begin)
    return total.astype(">u4").tobytes(), at[::STEP]


def unpack_bits(bits: bytes, checkpoints: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """All ids of a block, a section of checkpoints after the other."""
    out = []
    for a in range(0, len(checkpoints), SECTION):
        some = checkpoints[a:a + SECTION]
        low = int(some[0]) >> 3
        high = int(checkpoints[a + SECTION]) // 8 + 1 if a + SECTION < len(checkpoints) else len(bits)
        # places inside a section need 32 bits only
        out.append(_unpack_section(bits[low:high], (some - np.uint64(8 * low)).astype(np.uint32), table))
    return np.concatenate(out)[:n] if out else np.zeros(0, np.uint32)


def _unpack_section(bits: bytes, at: np.ndarray, table: np.ndarray) -> np.ndarray:
    """STEP ids from every place ``at``; all places advance by one id a step."""
    raw = np.frombuffer(bits + b"\0" * 64, np.uint8).astype(np.uint32)
    ahead = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
    out = np.zeros((STEP, len(at)), np.uint32)
    mask, top, last = np.uint32((1 << MAX_BITS) - 1), np.uint32(32 - MAX_BITS), np.uint32(len(ahead) - 1)
    three, seven, five, low = np.uint32(3), np.uint32(7), np.uint32(5), np.uint32(31)
    for k in range(STEP):
        found = table[(ahead[np.minimum(at >> three, last)] >> (top - (at & seven))) & mask]
        np.right_shift(found, five, out=out[k])
        at += found & low
    return out.T.reshape(-1)


def encode_blocks(ids: DataFrame, lengths: np.ndarray, bases: dict[int, int], dtype: str) -> DataFrame:
    """The file rows: independent blocks of whole documents in ascending order."""
    lengths_, codes = lengths, canonical_codes(lengths)

    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64())),
                        ("checkpoints", pa.binary()), ("bits", pa.binary())])

    def block(part: int, held: list[tuple]) -> pa.RecordBatch:
        all_ids = np.concatenate([x[0] for x in held])
        bits, checkpoints = pack_bits(all_ids, lengths_, codes)
        row = {"part": part, "block": held[0][3], "start": bases[part] + held[0][4], "n_ids": len(all_ids),
               "doc_ids": [d for x in held for d in x[1]], "doc_sizes": [n for x in held for n in x[2]],
               "checkpoints": checkpoints.tobytes(), "bits": bits}
        return pa.RecordBatch.from_pylist([row], schema=schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # runs of documents: ids, doc_ids, sizes, first seq, first place
        part, size = -1, 0
        for b in batches:
            values, offsets = binary_values(b.column("ids"), dtype)
            parts, seqs, places = (b.column(c).to_numpy() for c in ("part", "seq", "at"))
            a = 0
            while a < len(parts):
                if held and parts[a] != part:
                    yield block(part, held)
                    held, size = [], 0
                part = int(parts[a])
                same = a + int(np.searchsorted(-(parts[a:] == part).astype(np.int8), 0))
                z = int(np.searchsorted(offsets, offsets[a] + BLOCK_IDS - size, side="right")) - 1
                z = min(max(z, a + (not held)), same)
                if z > a:
                    held.append((values[offsets[a]:offsets[z]], b.column("doc_id")[a:z].to_pylist(),
                                 np.diff(offsets[a:z + 1]).tolist(), int(seqs[a]), int(places[a])))
                    size += int(offsets[z] - offsets[a])
                if z < same:  # the next document does not fit
                    yield block(part, held)
                    held, size = [], 0
                a = z
        if held:
            yield block(part, held)

    return in_arrow(ids, encode, BLOCK_SCHEMA)


def stored_lengths(spark: SparkSession, folder: str) -> np.ndarray:
    """The code lengths of a folder, by id (at most one a word of the vocabulary)."""
    rows = spark.read.schema(LENGTHS_SCHEMA).parquet(f"{folder}/lengths").collect()
    lengths = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.uint8)
    for r in rows:
        lengths[r["id"]] = r["bits"]
    return lengths


def decode_blocks(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, ids): every document back from the files, as little-endian 32-bit ids.

    With ``digest`` n_tokens and the ids' checksum take the place of the ids.
    """
    lengths = stored_lengths(spark, folder)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for b in batches:
            for r in b.to_pylist():
                ids = unpack_bits(r["bits"], np.frombuffer(r["checkpoints"], np.uint64), r["n_ids"], table).astype("<u4")
                offsets = np.concatenate([[0], np.cumsum(r["doc_sizes"])]).astype(np.int64)
                own = [pa.array(r["doc_ids"], pa.int64()), pa.array(r["start"] + offsets[:-1])]
                if digest:
                    data = memoryview(ids.tobytes())
                    crc = [zlib.crc32(data[4 * a:4 * z]) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(offsets)), pa.array(crc, pa.int64())],
                                                     ["doc_id", "start", "n_tokens", "ids_crc32"])
                else:
                    yield pa.RecordBatch.from_arrays([*own, binary_column(ids, offsets)], ["doc_id", "start", "ids"])

    return in_arrow(blocks, decode, "doc_id bigint, start bigint, " + ("n_tokens bigint, ids_crc32 bigint" if digest else "ids binary"))


def write_huffman(docs: DataFrame, path: str, folder: str, cut: str = "space", end_id: int = 2) -> None:
    """Encode ``docs`` into ``folder``: ``lengths`` (a row an id that occurs) and ``blocks``."""
    spark, dtype = docs.sparkSession, encoder(path, cut).dtype
    ids = staged(token_ids(docs, path, cut, end_id), "token-ids")
    counts = {r["id"]: r["n"] for r in id_counts(ids, dtype).collect()}  # bounded by the vocabulary
    table = np.zeros(max(counts, default=0) + 1, np.int64)
    table[list(counts)] = list(counts.values())
    lengths = code_lengths(table)
    sizes = dict(sorted((r["part"], r["n"]) for r in ids.groupBy("part").agg(F.sum("n").alias("n")).collect()))
    starts = np.cumsum([0, *sizes.values()])
    bases = {part: int(x) for part, x in zip(sizes, starts)}  # one number a partition
    used = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(used, LENGTHS_SCHEMA).coalesce(1).write.parquet(f"{folder}/lengths")
    encode_blocks(ids, lengths, bases, dtype).write.parquet(f"{folder}/blocks")


def huffman_report(docs: DataFrame, path: str) -> DataFrame:
    """Per document, from the files: its start, its ids and their checksum."""
    folder = scratch_path(docs.sparkSession, "huffman")
    write_huffman(docs, path, folder)
    return decode_blocks(docs.sparkSession, folder, digest=True)
