"""Suffix-array dedup: repeated byte strings by longest previous factors.

A byte goes if it is covered by a string of ``length`` bytes that also starts
elsewhere.  The suffixes of all texts are sorted in shards that no match
crosses:

1. Anchors: each window of ``length`` bytes has an anchor, its ``GRAM``-byte
   gram with the smallest fingerprint (leftmost on ties).  Equal windows have
   equal anchors at equal offsets, so they meet in the anchor's shard.
   Consecutive windows with one anchor are one segment.
2. Equal segments are counted before anything is sent; a segment that occurs
   twice is repeated throughout.  Only shards with several different segments
   need their bytes, one copy of each.
3. There the suffixes that begin windows are put into suffix order up to
   ``length`` bytes (prefix doubling).  In that order the previous and next
   smaller positions of a suffix, and the greater ones, are its neighbours in
   the run of equal prefixes: the longest previous factor reaches ``length``
   if the suffix is not the first of its run, the longest next factor if it
   is not the last.
4. Shards of more than ``SHARD`` segments are split: a range of offsets is
   halved, which lengthens the bytes that all its windows share, and the
   longer shared string is the new shard.  At single offsets it is the window
   itself and the shard needs counting only.  No shard is capped.
5. The runs go back to every occurrence of their segment and are merged.

Passages of ``WORDS`` words may be shorter than ``length`` bytes.  The same
steps run over words (runs of characters other than ASCII white space, as
64-bit fingerprints), in the same jobs: bit 0 of an anchor's fingerprint says
whether its segment is of bytes or of words.  Words count where another row
has the passage too, not where one text repeats itself; they are reported
(``n_passage_words``), not removed.

Anchors that occur once are dropped before their segments are grouped.

``keep="none"`` removes every copy, ``keep="first"`` all but the first (by
doc_id, then position; equal texts with equal doc_ids count as one).

Edge cases: null text is empty; matches never cross documents; overlapping
matches count; texts shorter than ``length`` lose nothing; rows with null or
repeated doc_ids keep their own result; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlens.llm.common import (ASCII_SPACE, byte_words, doc_slices, drop_staged, in_arrow, keyed_groups, mix64, prefix_hash, runs_of,
                                   span_hash, staged, text_buffers, text_or_empty, wide_parallelism)

LENGTH = 400
GRAM = 128
#: Words of a passage, and of its anchor's gram.
WORDS = 51
WORD_GRAM = 10
SHARD = 1000
#: Bytes of a split range that one word stands for.
WORD_SPLIT = 64
BATCH_BYTES = 1 << 20
#: Parts that the copies of one text are dealt to.
SALTS = 16
_PLACE = np.uint64((1 << 24) - 1)
#: Windows handled at once; longer texts are cut into overlapping parts.
PART = 1 << 22
_WORD = np.ones(256, bool)
_WORD[[ord(c) for c in ASCII_SPACE]] = False


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values (block prefixes and suffixes)."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, ~np.uint64(0))
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def segments_of(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """doc, anchor place, first and last window start, anchor and segment fingerprints.

    ``ends``: offsets of the documents in ``data``, at most 2^24 bytes.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return (none,) * 6
    prefix = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    print_ = span_hash(prefix, at, at + gram)
    # the place breaks ties from the left, the same way in every copy
    least = sliding_least((print_ & ~_PLACE) | at.astype(np.uint64), length - gram + 1)
    # runs of windows with one anchor, cut where a document begins or can hold no further window
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    lo = np.unique(np.concatenate([[0], change, ends[:-1][ends[:-1] < len(least)]]))
    doc = np.searchsorted(ends, lo, side="right") - 1
    hi = np.minimum(np.append(lo[1:], len(least)) - 1, ends[doc + 1] - length)
    some = hi >= lo
    lo, hi, doc = lo[some], hi[some], doc[some]
    if not len(lo):
        return (none,) * 6
    anchor = (least[lo] & _PLACE).astype(np.int64)
    whole = span_hash(prefix, lo, hi + length)
    digest = mix64(whole + (anchor - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (hi - lo).astype(np.uint64))
    return doc, anchor, lo, hi, print_[anchor], digest


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start and end byte and fingerprint of every word, and the first word of each document."""
    if len(offsets) == 2:  # one document, perhaps a long one
        start, end = runs_of(_WORD[data])
        first = np.array([0, len(start)])
    else:
        start, end, first = byte_words(data, offsets, _WORD)
    symbol = np.zeros(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        base, hi = start[lo], int(np.searchsorted(end, start[lo] + PART, side="right"))
        if hi <= lo:  # a single word longer than a part
            symbol[lo] = int.from_bytes(hashlib.blake2b(data[base:end[lo]].tobytes(), digest_size=8).digest(), "little")
            hi = lo + 1
        else:
            symbol[lo:hi] = span_hash(prefix_hash(data[base:end[hi - 1]]), start[lo:hi] - base, end[lo:hi] - base)
        lo = hi
    return start, end, symbol, first


OCCURRENCES = "a bigint, d bigint, doc_id bigint, key bigint, p bigint, near int, far int, at int, size int, fresh int"


def occurrences(docs: DataFrame, length: int, gram: int, words: int = 0) -> DataFrame:
    """(a, d, doc_id, key, p, near, far, at, size, fresh): every segment of every text.

    a: anchor's fingerprint, d: segment's, p: the anchor's byte; its windows
    start ``near`` to ``far`` bytes before p.  at, size: the segment's bytes.
    With ``words`` also the segments of windows of as many words, where p, near
    and far count words; fresh: 0 where the row has had the segment before.
    """

    def columns(ids, keys, doc, p, lo, hi, anchor, digest, at, size, fresh, kind):
        a = (anchor & ~np.uint64(1)) | np.uint64(kind)
        return pa.RecordBatch.from_arrays([
            pa.array(a.view(np.int64)), pa.array(digest.view(np.int64)), ids.take(pa.array(doc)), pa.array(keys[doc]), pa.array(p),
            *(pa.array(x.astype(np.int32)) for x in (hi, lo, at, size, fresh))],
            ["a", "d", "doc_id", "key", "p", "near", "far", "at", "size", "fresh"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            ids, keys = b.column("doc_id"), b.column("key").to_numpy()
            for a, z in doc_slices(offsets):
                for begin in range(int(offsets[a]), max(int(offsets[z]) - length + 1, int(offsets[a]) + 1), PART):
                    end = min(begin + PART + length - 1, int(offsets[z]))  # parts share length - 1 bytes
                    doc, p, lo, hi, anchor, digest = segments_of(
                        data[begin:end], np.clip(offsets[a:z + 1] - begin, 0, end - begin), length, gram)
                    if len(doc):
                        doc = doc + a
                        yield columns(ids, keys, doc, p + begin - offsets[doc], p - lo, p - hi, anchor.view(np.uint64), digest,
                                      lo + begin - offsets[doc], hi - lo + length, np.ones(len(doc)), 0)
                if not words:
                    continue
                start, stop, symbol, first = word_symbols(data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a])
                known = np.zeros(0, np.uint64)
                for begin in range(0, max(len(symbol) - words + 1, 0), PART):
                    end = min(begin + PART + words - 1, len(symbol))
                    doc, p, lo, hi, anchor, digest = segments_of(
                        symbol[begin:end], np.clip(first - begin, 0, end - begin), words, min(WORD_GRAM, -(-words // 4)))
                    if not len(doc):
                        continue
                    own = mix64(digest + doc.astype(np.uint64))
                    fresh = np.zeros(len(doc), bool)
                    fresh[np.unique(own, return_index=True)[1]] = True
                    if begin or end < len(symbol):  # one long document in parts
                        fresh &= ~np.isin(own, known)
                        known = np.concatenate([known, own[fresh]])
                    at = start[lo + begin]
                    yield columns(ids, keys, doc + a, p + begin - first[doc], p - lo, p - hi, anchor, digest,
                                  at + offsets[a] - offsets[doc + a], stop[hi + begin + words - 1] - at, fresh, 1)

    return in_arrow(docs, run, OCCURRENCES)


def prefix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of each suffix by its first ``length`` bytes or 64-bit symbols (a zero beyond the end); equal prefixes, equal ranks."""
    n = len(data)
    if data.dtype == np.uint64:
        rank, have = np.unique(data, return_inverse=True)[1], 1
    else:
        word = np.zeros(n + 8, np.uint64)
        word[:n] = data
        key = np.zeros(n, np.uint64)
        for k in range(8):
            key = (key << np.uint64(8)) | word[k:k + n]
        rank, have = np.unique(key, return_inverse=True)[1], 8
    while have < length:
        if n < 1 << 21:  # three ranks fit in one key
            last = min(2 * have, length - have)
            offsets, bits, have = (min(have, last), last), 21, have + last
        else:
            last = min(have, length - have)
            offsets, bits, have = (last,), 32, have + last
        key = rank.astype(np.uint64)
        for step in offsets:  # the parts may overlap
            key <<= np.uint64(bits)
            key[:n - step] |= rank[step:].astype(np.uint64) + np.uint64(1)
        rank = np.unique(key, return_inverse=True)[1]
    return rank


def factor_ends(rank: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the longest previous and next factors of some suffixes reach the ranked length.

    ``place`` orders the positions.  In suffix order with ties by place, the
    previous smaller position within the run of equal ranks is the neighbour
    before, the next greater one the neighbour after.
    """
    order = np.lexsort((place, rank))
    equal = rank[order][1:] == rank[order][:-1]
    earlier, later = np.zeros(len(rank), bool), np.zeros(len(rank), bool)
    earlier[order[1:]] = equal
    later[order[:-1]] = equal
    return earlier, later


def in_several_rows(equal: np.ndarray, row: np.ndarray, several: np.ndarray) -> np.ndarray:
    """Whether windows of one class ``equal`` (0, 1, ...) come from more than one row."""
    order = np.argsort(equal, kind="stable")
    begin = np.flatnonzero(np.diff(equal[order], prepend=-1))
    row, several = row[order], several[order]
    return ((np.minimum.reduceat(row, begin) != np.maximum.reduceat(row, begin)) | np.logical_or.reduceat(several, begin))[equal]


def _repeated(rows: pa.Table, length: int, words: bool = False) -> pa.RecordBatch:
    """Runs of window offsets of each segment that occur in another one (words: of another row).

    Several shards may come together: equal windows are always in one shard.
    ``first`` marks runs whose first occurrence is the segment itself.
    """
    data, offsets = text_buffers_of_binary(rows.column("bytes"))
    if words:
        data, offsets = np.frombuffer(data.tobytes(), np.uint64), offsets // 8
    far, near, order = (rows.column(c).to_numpy() for c in ("far", "near", "place"))
    n = far - near + 1
    rank = prefix_ranks(data, length)
    seg = np.repeat(np.arange(len(n)), n)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    own = rank[offsets[:-1][seg] + within]
    shard = np.unique(np.stack([rows.column("a").to_numpy(), rows.column("part").to_numpy()]), axis=1, return_inverse=True)[1].reshape(-1)
    own = np.unique(np.stack([shard[seg], own]), axis=1, return_inverse=True)[1].reshape(-1)
    if words:
        state = in_several_rows(own, rows.column("row").to_numpy()[seg], rows.column("several").to_numpy()[seg]).astype(np.int8)
    else:
        earlier, later = factor_ends(own, order[seg])
        state = np.where(earlier, 1, np.where(later, 2, 0)).astype(np.int8)  # 2: repeated, and here first
    edge = np.ones(len(state), bool)
    edge[1:] = (state[1:] != state[:-1]) | (seg[1:] != seg[:-1])
    begin = np.flatnonzero(edge)
    stop = np.append(begin[1:], len(state)) - 1
    keep = state[begin] > 0
    begin, stop = begin[keep], stop[keep]
    at = seg[begin]
    return pa.RecordBatch.from_arrays([
        rows.column("a").combine_chunks().take(pa.array(at)), rows.column("d").combine_chunks().take(pa.array(at)),
        pa.array((far[at] - within[stop]).astype(np.int32)), pa.array((far[at] - within[begin]).astype(np.int32)),
        pa.array(state[begin] == 2)], ["a", "d", "near", "far", "first"])


def text_buffers_of_binary(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    return text_buffers(column.cast(pa.large_binary()).combine_chunks().view(pa.large_string()))


RUNS = "a bigint, d bigint, near int, far int, first boolean"


def of_words() -> Column:
    return F.col("a").bitwiseAND(F.lit(1)) == 1


ITEMS = "a bigint, d bigint, near int, far int, place bigint, row bigint, several boolean, part bigint, bytes binary"


def _bytes_of(segments: DataFrame, docs: DataFrame) -> DataFrame:
    """``segments`` with the bytes of their windows, cut from the text of their first occurrence; words as 64-bit symbols."""
    wanted = segments.select("a", "d", "n", "place", F.col("rep.*"))
    source = docs.select(F.col("doc_id").alias("id2"), F.col("key").alias("key2"), "text")
    joined = wanted.join(source, (F.col("key") == F.col("key2")) & F.col("doc_id").eqNullSafe(F.col("id2")))
    piece = F.substring(F.encode("text", "UTF-8"), F.col("at") + 1, F.col("size"))
    cut = joined.select("a", "d", "near", "far", "place", F.xxhash64("doc_id", "key").alias("row"), (F.col("n") > 1).alias("several"),
                        F.lit(0).cast("long").alias("part"), piece.alias("bytes")).dropDuplicates(["a", "d"])

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = (b.column("a").to_numpy() & 1).astype(bool)
            yield b.filter(pa.array(~kind))
            some = b.filter(pa.array(kind))
            if some.num_rows:
                data, offsets = text_buffers_of_binary(pa.chunked_array([some.column("bytes")]))
                _, _, symbol, first = word_symbols(data, offsets)
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), some.num_rows, [
                    None, pa.py_buffer((first * 8).astype(np.int64).tobytes()), pa.py_buffer(symbol.tobytes())])
                yield some.set_column(some.schema.get_field_index("bytes"), "bytes", raw.cast(pa.binary()))

    return in_arrow(cut, symbols, ITEMS)


def _split(items: DataFrame, size: int, length: int, words: int) -> DataFrame:
    """Items over ranges of at most ``size`` offsets (words: a ``WORD_SPLIT``-th), with the string that their windows share as ``core``."""
    step, wide, unit = (F.when(of_words(), y).otherwise(x) for x, y in ((size, max(size // WORD_SPLIT, 1)), (length, words), (1, 8)))
    low = F.explode(F.sequence((F.col("near") / step).cast("int"), (F.col("far") / step).cast("int")))
    cut = items.withColumn("k", low)
    near, far = F.greatest("near", F.col("k") * step), F.least("far", F.col("k") * step + step - 1)
    # windows of offsets [k * step, k * step + step) share the bytes from p - k * step to p - (k * step + step - 1) + wide
    begin = F.col("far") - F.col("k") * step
    shared = F.substring("bytes", (begin * unit + 1).cast("int"), ((wide - step + 1) * unit).cast("int"))
    return cut.select("a", "d", near.alias("near"), far.alias("far"), "place", "row", "several",
                      F.xxhash64("part", "k", shared, F.lit(size)).alias("part"),
                      F.substring("bytes", ((F.col("far") - far) * unit + 1).cast("int"), ((far - near + wide) * unit).cast("int")).alias("bytes"))


def repeated_runs(segments: DataFrame, docs: DataFrame, length: int, shard: int = SHARD, words: int = WORDS) -> DataFrame:
    """(a, d, near, far, first): the repeated window offsets of segments in shards with several of them."""
    items = staged(_bytes_of(segments, docs), "suffix-items")
    out, split = None, False
    spark = docs.sparkSession

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = [], []
        total = [0, 0]
        for group in keyed_groups(batches, ["a", "part"]):
            if group.num_rows > 1:
                kind = group.column("a")[0].as_py() & 1
                held[kind].append(group)
                total[kind] += pc.sum(pc.binary_length(group.column("bytes"))).as_py()
                if total[kind] >= BATCH_BYTES << 3 * kind:
                    yield _repeated(pa.concat_tables(held[kind]), words if kind else length, bool(kind))
                    held[kind].clear()
                    total[kind] = 0
        for kind in (0, 1):
            if held[kind]:
                yield _repeated(pa.concat_tables(held[kind]), words if kind else length, bool(kind))

    size = 1 << (length - 1).bit_length()
    while True:
        counts = items.groupBy("a", "part").agg(F.count("*").alias("m"))
        large = staged(counts.filter(F.col("m") > shard).drop("m"), "suffix-large")
        rest = bool(large.take(1))
        small = items.join(large, ["a", "part"], "left_anti") if rest else items
        dealt = small.repartition(wide_parallelism(spark), "a", "part").sortWithinPartitions("a", "part")
        found = staged(in_arrow(dealt, compare, RUNS), "suffix-runs")
        out = found if out is None else out.unionByName(found)
        if not rest:
            return out
        many = items.join(large, ["a", "part"], "left_semi")
        # every item is one window and equal to the others of its shard
        if split and size <= WORD_SPLIT:
            alike = many.filter(of_words())
            across = alike.groupBy("a", "part").agg((F.max("several") | (F.min("row") != F.max("row"))).alias("across")).filter("across")
            out = out.unionByName(alike.join(across, ["a", "part"], "left_semi").select("a", "d", "near", "far", F.lit(False).alias("first")))
            many = many.filter(~of_words())
            if not large.filter(~of_words()).take(1):
                return out
        if split and size == 1:
            least = many.groupBy("a", "part").agg(F.min("place").alias("least"))
            return out.unionByName(many.join(least, ["a", "part"]).select(
                "a", "d", "near", "far", (F.col("place") == F.col("least")).alias("first")))
        size //= 2
        while size >= length - GRAM + 1:
            size //= 2
        items, split = staged(_split(many, size, length, words), "suffix-items"), True


def removed_spans(docs: DataFrame, length: int = LENGTH, keep: str = "none", gram: int = GRAM, shard: int = SHARD,
                  words: int = WORDS) -> DataFrame:
    """(doc_id, key, spans, passages): the windows to remove of each text that has some, as [first start, last start] pairs.

    ``docs`` has doc_id, key (a fingerprint of the text) and text.  passages:
    the same of the windows of ``words`` words that another row has, in words.
    """
    all_ = staged(occurrences(docs, length, gram, words), "suffix-occurrences")
    # an anchor that occurs once repeats nothing
    anchors = staged(all_.groupBy("a").agg(F.sum("fresh").alias("m")).filter("m > 1").select("a"), "suffix-anchors")
    every = staged(all_.join(anchors, "a", "left_semi"), "suffix-several")
    drop_staged(all_)
    rep = F.struct("doc_id", "key", "p", "near", "far", "at", "size")
    segments = staged(every.groupBy("a", "d").agg(F.sum("fresh").alias("n"), F.min(rep).alias("rep")), "suffix-segments")
    shards = staged(segments.groupBy("a").agg(F.count("*").alias("m")).filter("m > 1").select("a"), "suffix-shards")
    several = segments.join(shards, "a", "left_semi").withColumn("place", F.xxhash64("rep")) if keep == "none" else \
        _placed(segments.join(shards, "a", "left_semi"))
    runs = repeated_runs(several, docs, length, shard, words)
    twice = segments.filter("n > 1").select("a", "d", F.col("rep.near").alias("near"), F.col("rep.far").alias("far"), F.lit(True).alias("first"))
    # what occurs twice is gone throughout; the runs add to the other segments
    both = runs.select("a", "d", "near", "far").unionByName(twice.select("a", "d", "near", "far"))
    at = every.select("a", "d", "doc_id", "key", "p")
    if keep == "none":
        found = at.join(both, ["a", "d"])
    else:
        runs, twice = runs.filter(~of_words()), twice.filter(~of_words())
        # a segment that occurs twice and nowhere else begins at its first occurrence
        own = twice.join(runs.filter("NOT first").select("a", "d", F.col("near").alias("x"), F.col("far").alias("y")), ["a", "d"], "left")
        runs = runs.unionByName(own.filter("x IS NULL").select(*RUNS_COLUMNS)).unionByName(
            own.filter("x IS NOT NULL").select("a", "d", "near", "far", "first").distinct())
        marked = at.join(runs, ["a", "d"]).join(
            segments.select("a", "d", F.col("rep.doc_id").alias("i"), F.col("rep.key").alias("k"), F.col("rep.p").alias("q")), ["a", "d"])
        here = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")) & (F.col("p") == F.col("q"))
        found = marked.filter(~(F.col("first") & here)).drop("first", "i", "k", "q").unionByName(
            at.join(both.filter(of_words()), ["a", "d"]))
    span = F.struct((F.col("p") - F.col("far")).alias("s"), (F.col("p") - F.col("near")).alias("e"))
    # one document's own runs, bounded by its length
    return found.select("doc_id", "key", F.when(~of_words(), span).alias("span"), F.when(of_words(), span).alias("passage")).groupBy(
        "doc_id", "key").agg(F.sort_array(F.collect_set("span")).alias("spans"), F.sort_array(F.collect_set("passage")).alias("passages"))


RUNS_COLUMNS = ["a", "d", "near", "far", "first"]


def _placed(segments: DataFrame) -> DataFrame:
    """``place``: a number in the order of the first occurrences (doc_id, key, position)."""
    order = F.struct(F.col("rep.doc_id"), F.col("rep.key"), F.col("rep.p"))
    dealt = staged(segments.repartitionByRange(wide_parallelism(segments.sparkSession), order).sortWithinPartitions(order)
                   .withColumn("place", F.monotonically_increasing_id()), "suffix-placed")
    return dealt


CUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text string, n_passage_words bigint"


def passage_words(text: str, whole: bool, passages: list | None, words: int) -> int:
    """Words within passages that another row has; ``whole``: it has the text."""
    if whole:
        n = len(text.encode().split())  # bytes: ASCII white space only
        return n if n >= words else 0
    n = end = 0
    for x in passages or ():  # ascending
        n += max(x["e"] + words - max(x["s"], end), 0)
        end = max(end, x["e"] + words)
    return n


def cut_texts(joined: DataFrame, length: int, words: int = WORDS) -> DataFrame:
    """``CUT`` columns of rows with doc_id, text, ``whole`` (all of it goes), ``spans`` (of first and last starts) and ``passages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            texts, wholes, passages = (b.column(c).to_pylist() for c in ("text", "whole", "passages"))
            for text, whole, spans in zip(texts, wholes, b.column("spans").to_pylist()):
                raw = text.encode()
                if whole:
                    out.append((len(raw), len(raw), 1, hashlib.sha256(b"").hexdigest(), ""))
                elif not spans:
                    out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), text))
                else:
                    gone = np.zeros(len(raw) + 1, np.int64)
                    at = np.array([(x["s"], x["e"] + length) for x in spans], np.int64).reshape(-1, 2)
                    np.add.at(gone, at[:, 0], 1)
                    np.subtract.at(gone, at[:, 1], 1)
                    flags = np.cumsum(gone[:-1]) > 0
                    left = np.frombuffer(raw, np.uint8)[~flags].tobytes()
                    out.append((len(raw), int(flags.sum()), len(runs_of(flags)[0]), hashlib.sha256(left).hexdigest(), left.decode(errors="ignore")))
            columns = list(zip(*out)) or [()] * 5
            counts = [passage_words(*x, words) for x in zip(texts, wholes, passages)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string()),
                 pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "n_passage_words"])

    return in_arrow(joined, run, CUT)


def copied_texts(source: DataFrame, length: int) -> DataFrame:
    """(doc_id, key) of texts of ``length`` bytes or more that occur in several rows: all of them occurs elsewhere.

    Only digests that occur twice are joined, under ``SALTS`` numbers, so that
    the copies of one text are spread over as many tasks.
    """
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    index = staged(source.filter(F.octet_length("text") >= length).select("doc_id", "key", F.sha2("text", 256).alias("sha"), salt.alias("salt")), "suffix-index")
    several = index.groupBy("sha").agg(F.count("*").alias("copies")).filter("copies > 1")
    several = several.select("sha", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("salt"))
    return index.join(several, ["sha", "salt"], "left_semi").select("doc_id", "key").distinct()


def dedup(docs: DataFrame, length: int = LENGTH, keep: str = "none", gram: int = GRAM, shard: int = SHARD, words: int = WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, the remaining ``text`` and n_passage_words of every row.

    The digest is that of the remaining bytes.  Where a cut splits a character,
    ``text`` leaves its other bytes out.  n_passage_words: words of the whole
    text in passages of ``words`` words or more that another row has too.
    """
    text = text_or_empty()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    changed = removed_spans(source, length, keep, gram, shard, words).withColumn("whole", F.lit(False))
    if keep == "none":
        copies = staged(copied_texts(source, length).withColumn("whole", F.lit(True)), "suffix-copies")
        same = changed["doc_id"].eqNullSafe(copies["doc_id"]) & (changed["key"] == copies["key"])
        changed = changed.join(copies, same, "left_anti").unionByName(copies, allowMissingColumns=True)
    changed = staged(changed.select(F.col("doc_id").alias("i"), F.col("key").alias("k"), "whole", "spans", "passages"), "suffix-spans")
    joined = source.join(changed, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("i")), "left")
    return cut_texts(joined.select("doc_id", "text", "whole", "spans", "passages"), length, words)


def suffix_report(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text"))
