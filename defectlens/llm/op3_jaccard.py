"""N-gram Jaccard join with Bayesian candidate pruning.

Sets are the distinct runs of five words (lower case; letters, digits and
characters beyond ASCII; a shorter text is one run).  Two documents are linked
if the Jaccard similarity of their sets is 0.8 or more.

1. Documents with equal sets form a class; only classes are compared.
2. ``HASHES`` MinHash values a class; classes that agree on a whole band share
   a bucket.  Candidates are the pairs that share a bucket, never more.  A bucket
   gives star edges to its smallest class; their components only say which
   classes are verified near each other.
3. The MinHash values of a pair are compared ``STEP`` at a time.  After k values
   with m agreements the posterior probability that the similarity reaches the
   threshold, from a uniform prior, is P(Bin(k + 1, t) <= m); the pair is
   dropped when it falls below ``TOLERANCE``.  A component of at most ``BLOCK``
   classes is one task of this kind.  Larger components are compared bucket by
   bucket on the MinHash values alone (buckets are dealt in blocks to pairs of
   blocks, and a pair counts in its first common bucket only).
4. The texts of the pairs that are left go to tasks (component, block, block), a
   text to a task only if it has a pair there: the rows sent are at most two a
   pair, and at most the blocks of its component a class.
5. What is left is verified on the whole sets.  A task returns a row for each
   of its classes: the documents it is linked to, and one link to the smallest
   class it reaches.  Pairs are not written, however large a group is.

No bucket, block or component has a cap.  A pair at the threshold shares no
band with a probability of (1 - 0.8^4)^24, below 4e-6.

Edge cases: null text has no words; a text without words is linked to nothing;
equal texts are one class whatever their ids; null and repeated doc_ids keep
their rows, class_id is the smallest id of the class that is not null; an
empty table gives an empty result; other columns are carried by
:func:`keep_one` unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlens.llm.common import (byte_words, doc_slices, in_arrow, keyed_groups, mix64, prefix_hash, small_batches,
                                   span_hash, staged, text_buffers, text_or_empty, wide_parallelism)
from defectlens.llm.components import components

WORDS = 5
THRESHOLD = (4, 5)  # 0.8 as a fraction, so that the comparison is exact
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
STEP = 8
TOLERANCE = 1e-6
BLOCK = 256

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_SEED = np.random.default_rng(20240501)
_A = _SEED.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _SEED.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints of each text, and their offsets."""
    start, end, first = byte_words(data, offsets, _WORD)
    words = prefix_hash(span_hash(prefix_hash(data), start, end))
    n_words = np.diff(first)
    n = np.where(n_words > 0, np.maximum(n_words - WORDS + 1, 1), 0)
    at = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    begin = first[:-1][doc] + np.arange(at[-1]) - at[:-1][doc]
    values = span_hash(words, begin, np.minimum(begin + WORDS, first[1:][doc]))
    for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
        values[a:z].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[fresh], np.concatenate([[0], np.cumsum(np.bincount(doc[fresh], minlength=len(n)))])


def _sets_in_slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`shingle_sets` of many texts, a bounded number of bytes at a time."""
    parts, sizes = [], []
    for a, z in doc_slices(offsets):
        values, ends = shingle_sets(data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a])
        parts.append(values)
        sizes.append(np.diff(ends))
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values of non-empty sets, one row a set."""
    out = np.empty((len(offsets) - 1, HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((values * _A[k] + _B[k]) >> np.uint64(32), offsets[:-1])
    return out


def band_values(signature: np.ndarray) -> np.ndarray:
    """One 64-bit value for each band of each row."""
    v = np.zeros((len(signature), BANDS), np.uint64)
    for r in range(ROWS):
        v = mix64(v * np.uint64(0x9E3779B97F4A7C15) + signature[:, r::ROWS].astype(np.uint64) + np.uint64(1))
    return mix64(v + np.arange(BANDS, dtype=np.uint64))


def features(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, f1, f2, n_set, signature): a set's fingerprint, size and MinHash values."""
    source = docs.select(F.col(key).cast("long").alias("key"), F.lower(text_or_empty(text)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            for a, z in doc_slices(offsets):
                values, ends = shingle_sets(data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a])
                n = np.diff(ends)
                some = np.flatnonzero(n)
                f = np.zeros((2, z - a), np.uint64)
                signature = np.zeros((z - a, HASHES), np.uint32)
                if len(some):
                    for i, salt in enumerate((0x1234567, 0x89ABCDEF)):
                        f[i, some] = np.add.reduceat(mix64(values + np.uint64(salt)), ends[:-1][some])
                    signature[some] = signatures(values, np.append(ends[:-1][some], len(values)))
                raw, size = signature.tobytes(), HASHES * 4
                yield pa.RecordBatch.from_arrays([
                    b.column("key")[a:z], pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), pa.array(n.astype(np.int64)),
                    pa.array([raw[k * size:(k + 1) * size] for k in range(z - a)], pa.binary())],
                    ["key", "f1", "f2", "n_set", "signature"])

    return in_arrow(source, run, "key bigint, f1 bigint, f2 bigint, n_set bigint, signature binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """(bucket, id): a row for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signature = np.frombuffer(b"".join(b.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
            yield pa.RecordBatch.from_arrays([pa.array(band_values(signature).reshape(-1).view(np.int64)),
                                              pa.array(np.repeat(b.column("id").to_numpy(), BANDS))], ["bucket", "id"])

    return in_arrow(classes.select("id", "signature"), run, "bucket bigint, id bigint")


@lru_cache
def least_agreements(tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For each number of values compared, the fewest agreements that keep a pair."""
    t = THRESHOLD[0] / THRESHOLD[1]
    out = []
    for k in range(HASHES + 1):
        tail, m = 0.0, 0
        while m <= k:
            tail += math.comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append(m)
    return tuple(out)


def likely_pairs(left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that survive the incremental comparison of MinHash values."""
    least, out = least_agreements(), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]  # one side may be empty
    strip = max(1, (1 << 18) // max(1, len(right)))
    for a in range(0, len(left), strip):
        rows = np.arange(a, min(a + strip, len(left)))
        i, j = np.repeat(rows, len(right)), np.tile(np.arange(len(right)), len(rows))
        if same:
            i, j = i[i < j], j[i < j]
        agree = np.zeros(len(i), np.int32)
        for k in range(0, HASHES, STEP):
            agree += (left[i, k:k + STEP] == right[j, k:k + STEP]).sum(axis=1, dtype=np.int32)
            keep = agree >= least[k + STEP]
            i, j, agree = i[keep], j[keep], agree[keep]
            if not len(i):
                break
        out.append((i, j))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def shared_counts(values: np.ndarray, ends: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets i[k] and j[k], exactly."""
    rows, local = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = local[:len(i)], local[len(i):]
    n = np.diff(ends)[rows]
    member = np.repeat(np.arange(len(rows)), n)
    at = np.repeat(ends[:-1][rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    _, symbol, count = np.unique(values[at], return_inverse=True, return_counts=True)
    often = count > 1
    rank = np.cumsum(often) - 1
    keep = often[symbol]
    member, symbol, width = member[keep], rank[symbol[keep]], int(often.sum())
    out = np.zeros(len(i), np.int64)
    if len(i) * 25_000 < len(rows) * len(rows) * width // 8:  # few pairs: one by one
        order = np.lexsort((symbol, member))
        symbol, bounds = symbol[order], np.searchsorted(member[order], np.arange(len(rows) + 1))
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            out[k] = len(np.intersect1d(symbol[bounds[x]:bounds[x + 1]], symbol[bounds[y]:bounds[y + 1]], assume_unique=True))
        return out
    for c in range(0, width, 4096):  # many pairs: a product of the membership matrices, some columns at a time
        inside = (symbol >= c) & (symbol < c + 4096)
        m = np.zeros((len(rows), min(4096, width - c)), np.float32)
        m[member[inside], symbol[inside] - c] = 1
        out += (m @ m.T)[a, b].astype(np.int64)
    return out


def _compared(rows: pa.Table) -> pa.RecordBatch:
    """Links and the smallest reached class of each class of one or two blocks."""
    ids, weight, side = (rows.column(c).to_numpy() for c in ("id", "n_docs", "side"))
    values, ends = _sets_in_slices(*text_buffers(rows.column("text")))
    sizes = np.diff(ends)
    signature = signatures(values, ends)
    left = np.flatnonzero(side == 0)
    two = bool((side == 1).any())
    right = np.flatnonzero(side == 1) if two else left
    i, j = likely_pairs(signature[left], signature[right], not two)
    i, j = left[i], right[j]
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    if len(i):
        both = shared_counts(values, ends, i, j)
        linked = both * THRESHOLD[1] >= (sizes[i] + sizes[j] - both) * THRESHOLD[0]
        i, j = i[linked], j[linked]
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        while True:  # the least rank reached, by pointer jumping
            before = rank.copy()
            np.minimum.at(rank, i, rank[j])
            np.minimum.at(rank, j, rank[i])
            if (before == rank).all():
                break
        root = order[rank]
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(ids[root])], ["id", "links", "peer"])


def _in_blocks(size: str) -> Column:
    """The block of a class among those of a group of ``size`` classes."""
    return F.pmod(F.xxhash64("id"), F.ceil(F.col(size) / BLOCK).cast("int")).cast("int")


def _bucket_tasks(rows: DataFrame) -> DataFrame:
    """Rows of large buckets (bucket, n, ...) dealt to the tasks (bucket, bx, by), bx <= by."""
    other = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / BLOCK).cast("int") - 1))
    return (rows.withColumn("own", _in_blocks("n")).withColumn("other", other)
            .withColumn("bx", F.least("own", "other")).withColumn("by", F.greatest("own", "other"))
            .withColumn("side", F.when(F.col("own") == F.col("bx"), 0).otherwise(1)).drop("own", "other", "n"))


def first_shared(bands: np.ndarray, i: np.ndarray, j: np.ndarray, band: int) -> np.ndarray:
    """Whether no band before ``band`` is common to the rows i[k] and j[k]."""
    fresh = np.ones(len(i), bool)
    for b in range(band):
        fresh &= bands[i, b] != bands[j, b]
    return fresh


def _left_in_bucket(rows: pa.Table) -> pa.RecordBatch:
    """(comp, x, y, id): where the classes of one task of a bucket have a pair to verify."""
    ids, block, side = (rows.column(c).to_numpy() for c in ("id", "block", "side"))
    signature = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
    bands = band_values(signature)
    band = int(np.flatnonzero(bands[0].view(np.int64) == rows.column("bucket")[0].as_py())[0])
    left = np.flatnonzero(side == 0)
    two = bool((side == 1).any())
    right = np.flatnonzero(side == 1) if two else left
    i, j = likely_pairs(signature[left], signature[right], not two)
    i, j = left[i], right[j]
    fresh = first_shared(bands, i, j, band)
    i, j = i[fresh], j[fresh]
    x, y = np.minimum(block[i], block[j]), np.maximum(block[i], block[j])
    places = np.unique(np.stack([np.tile(x, 2), np.tile(y, 2), np.concatenate([i, j])], axis=1), axis=0)
    comp = np.full(len(places), rows.column("comp")[0].as_py(), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(comp), pa.array(places[:, 0].astype(np.int32)), pa.array(places[:, 1].astype(np.int32)),
                                       pa.array(ids[places[:, 2]])], ["comp", "x", "y", "id"])


def _places(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """(comp, x, y, side, id): the tasks that need the text of a class, each once.

    ``members``: (id, comp, size, signature); ``buckets``: (bucket, n, id), n > 1.
    """
    spark = members.sparkSession
    small = members.filter(F.col("size") <= BLOCK).select("comp", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"), "id")
    large = members.filter(F.col("size") > BLOCK).select("id", "comp", _in_blocks("size").alias("block"), "signature")
    if not large.take(1):
        return small
    tasks = _bucket_tasks(buckets.select("bucket", "n", "id").join(large, "id"))
    dealt = (tasks.select("bucket", "bx", "by", "side", "id", "comp", "block", "signature")
             .repartition(wide_parallelism(spark), "bucket", "bx", "by").sortWithinPartitions("bucket", "bx", "by"))

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in keyed_groups(batches, ["bucket", "bx", "by"]):
            yield _left_in_bucket(group)

    found = in_arrow(dealt, left, "comp bigint, x int, y int, id bigint").distinct().join(large.select("id", "block"), "id")
    side = F.when(F.col("block") == F.col("x"), 0).otherwise(1)
    return small.unionByName(found.select("comp", "x", "y", side.alias("side"), "id"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, n_links, n_equal) for each row.

    ``class_id``: the smallest key that links lead to; ``n_links``: the other
    rows with a similarity of 0.8 or more; ``n_equal``: the rows with an equal
    set, this one included.
    """
    spark = docs.sparkSession
    rows = staged(features(docs, key, text), "jaccard-features")
    grouped = (rows.filter("n_set > 0").groupBy("f1", "f2")
               .agg(F.count("*").alias("n_docs"), F.min("key").alias("rep"), F.any_value("signature").alias("signature")))
    classes = staged(grouped.withColumn("id", F.monotonically_increasing_id()), "jaccard-classes")
    shared = _buckets(classes)
    shared = shared.groupBy("bucket").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1").join(shared, "bucket")
    buckets = staged(shared.select("bucket", "n", "id", "least"), "jaccard-buckets")
    near = components(buckets.select(F.col("id").alias("u"), F.col("least").alias("v")).filter("u <> v"))
    sizes = near.groupBy("root").agg(F.count("*").alias("size"))
    members = staged(near.join(sizes, "root").withColumnRenamed("root", "comp")
                     .join(classes.select(F.col("id").alias("node"), "f1", "f2", "rep", "n_docs", "signature"), "node")
                     .withColumnRenamed("node", "id"), "jaccard-members")
    places = _places(members.select("id", "comp", "size", "signature"), buckets)
    places = staged(places.join(members.select("id", "f1", "f2", "rep", "n_docs"), "id"), "jaccard-places")
    # one text of each class: by its key, then checked against the class (keys may repeat or be null)
    source = docs.select(F.col(key).cast("long").alias("key"), F.lower(text_or_empty(text)).alias("text"))
    # always a sorted merge: the places grow with the documents, and the plan is the same at every size
    task = ["comp", "x", "y", "side", "id"]
    texts = places.join(source.hint("merge"), places["rep"].eqNullSafe(source["key"])).select(*task, "n_docs", "f1", "f2", "text")
    texts = _of_class(texts).dropDuplicates(task) if _repeats(rows) else texts.drop("f1", "f2")
    dealt = texts.repartition(wide_parallelism(spark), "comp", "x", "y").sortWithinPartitions("comp", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in keyed_groups(batches, ["comp", "x", "y"]):
            yield _compared(group)

    found = staged(in_arrow(dealt.select("comp", "x", "y", "side", "id", "n_docs", "text"), compare, "id bigint, links bigint, peer bigint"), "jaccard-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    reached = components(found.filter("id <> peer").select(F.col("id").alias("u"), F.col("peer").alias("v")))
    named = (classes.select("id", "f1", "f2", "n_docs", "rep").join(links, "id", "left")
             .join(reached.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")))
    names = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    table = staged(named.join(names, "root").select("f1", "f2", "class_id", "n_docs", F.coalesce("links", F.lit(0)).alias("links")), "jaccard-table")
    return rows.select("key", "n_set", "f1", "f2").join(table, ["f1", "f2"], "left").select(
        "key", F.when(F.col("n_set") > 0, F.col("class_id")).otherwise(F.col("key")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("n_docs") - 1, F.lit(0)).alias("n_links"), F.coalesce("n_docs", F.lit(1)).alias("n_equal"))


def _repeats(rows: DataFrame) -> bool:
    """Whether a key is null or repeated, so that it does not name one text."""
    return bool(rows.groupBy("key").count().filter("count > 1 OR key IS NULL").take(1))


def _of_class(texts: DataFrame) -> DataFrame:
    """The rows whose text has the fingerprint of its class."""
    columns = ["comp", "x", "y", "side", "id", "n_docs", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            f1, f2 = b.column("f1").to_numpy(), b.column("f2").to_numpy()
            for a, z in doc_slices(offsets):
                values, ends = shingle_sets(data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a])
                keep = []
                for k in range(z - a):
                    own = values[ends[k]:ends[k + 1]]
                    f = [int(mix64(own + np.uint64(s)).sum(dtype=np.uint64).view(np.int64)) for s in (0x1234567, 0x89ABCDEF)]
                    keep.append(len(own) > 0 and f == [f1[a + k], f2[a + k]])
                yield b.select(columns).slice(a, z - a).filter(pa.array(keep, pa.bool_()))

    small_batches(texts.sparkSession)
    return in_arrow(texts, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name in columns))


def jaccard_report(docs: DataFrame) -> DataFrame:
    return join(docs.select("doc_id", "text")).withColumnRenamed("key", "doc_id")


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without the later members of each class; same columns."""
    columns, key = docs.columns, "__key"
    while key in columns:
        key += "_"
    ids = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    unique = ids[0] == ids[1] == ids[2]
    keyed = docs if unique else staged(docs.withColumn(key, F.monotonically_increasing_id()), "jaccard-keyed")
    name = "doc_id" if unique else key
    gone = staged(join(keyed, name, text).filter("key <> class_id").select(F.col("key").alias("__gone")), "jaccard-gone")
    return keyed.hint("merge").join(gone, keyed[name] == gone["__gone"], "left_anti").select(*[keyed[f"`{c}`"] for c in columns])
