"""Benchmark decontamination: a prefix-filtered join of document words with item windows.

A window is ``window`` consecutive words of an item (a shorter item is one
window) and is looked up as a set of three-word shingles that must all be
there.  So one shingle a window is a sufficient prefix: the rarest over all
documents.  Then

1. the benchmark's shingles are counted in all documents;
2. each window keeps its rarest shingle, with its place in the window;
3. a document word where that shingle begins gives one possible start a
   window; the window must lie within the document (length and position);
4. what is left is compared word by word, over the window's own length.

The benchmark is handled in blocks of at most ``BLOCK_CHARS`` characters, each one
scan of the documents; only one block at a time is sent to the tasks.  With
one block a document's result is whole in its scan, with more the hits are
joined by the text's digest.

Edge cases: null text has no words; an item without words has no window; items
with equal ids count once, a null id as the empty string; equal windows of
several items hit each of them; repeated documents are judged row by row; an
empty benchmark hits nothing; an empty table gives an empty result; other
columns are carried by :func:`drop_contaminated` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectlens.llm.common import byte_words, doc_slices, in_arrow, prefix_hash, span_hash, text_buffers, text_or_empty

WINDOW = 10
SHINGLE = 3
BLOCK_CHARS = 2_000_000
_FILTER_BITS = 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Digits, a to z and every byte of a character beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


class Words:
    """The words of some texts: a plain byte string of them and their fingerprints."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = _LOWER[data]
        start, end, self.first = byte_words(data, offsets, _WORD)
        self.value = span_hash(prefix_hash(data), start, end)
        self.prefix = prefix_hash(self.value)
        # words with one space between, so a run of words is one slice
        size = end - start
        self.at = np.cumsum(size + 1) - (size + 1)
        self.size = size
        plain = np.full(int((size + 1).sum()), 32, np.uint8)
        total = int(size.sum())
        shift = np.repeat(self.at - (np.cumsum(size) - size), size)
        plain[np.arange(total) + shift] = data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)]
        self.plain = plain.tobytes()

    def shingles(self, g: int) -> np.ndarray:
        """Fingerprints of g consecutive words (ignoring document ends)."""
        at = np.arange(max(0, len(self.value) - g + 1))
        return span_hash(self.prefix, at, at + g)

    def run(self, a: int, n: int) -> bytes:
        return self.plain[self.at[a]:self.at[a + n - 1] + self.size[a + n - 1]]


class Index:
    """A block of windows by one shingle each; what a task needs to scan texts."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        owners: dict[bytes, set[str]] = {}
        for name, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            w = Words(raw, np.array([0, len(raw)]))
            n = len(w.value)
            for a in range(n - window + 1 if n >= window else min(n, 1)):
                owners.setdefault(w.run(a, min(n, window)), set()).add(name)
        self.texts = list(owners)
        self.items = [sorted(owners[t]) for t in self.texts]
        self.sizes = np.array([t.count(b" ") + 1 for t in self.texts], np.int64)
        self.parts = []  # (shingle size, fingerprints by window and place, windows)
        for g in range(1, SHINGLE + 1):
            mine = np.flatnonzero(np.minimum(self.sizes, SHINGLE) == g)
            if len(mine):
                raw = np.frombuffer(b"".join(self.texts[i] for i in mine), np.uint8)
                ends = np.cumsum([0, *[len(self.texts[i]) for i in mine]])
                w = Words(raw, ends)
                values = w.shingles(g)
                unit = np.repeat(np.arange(len(mine)), self.sizes[mine] - g + 1)
                place = np.arange(len(unit)) - np.searchsorted(unit, unit)
                self.parts.append((g, values[w.first[unit] + place], mine[unit], place))

    def tokens(self) -> list[tuple[int, np.ndarray]]:
        return [(g, np.unique(v)) for g, v, _, _ in self.parts]

    def keep_rarest(self, counts: dict[tuple[int, int], int]) -> None:
        """Reduce every window to its rarest shingle (ties: smallest fingerprint)."""
        kept = []
        for g, value, unit, place in self.parts:
            tokens = np.unique(value)
            n = np.array([counts.get((g, i), 0) for i in range(len(tokens))], np.int64)
            at = np.searchsorted(tokens, value)
            order = np.lexsort((place, value, n[at], unit))
            order = order[np.concatenate([[True], unit[order][1:] != unit[order][:-1]])]
            order = order[n[at[order]] > 0]  # a shingle that no document has
            order = order[np.argsort(value[order], kind="stable")]
            kept.append((g, value[order], unit[order], place[order]))
        self.parts = kept


def _members(values: np.ndarray, table: np.ndarray, filter_: np.ndarray) -> np.ndarray:
    """Positions of the values that the sorted table holds."""
    some = np.flatnonzero(filter_[values & np.uint64((1 << _FILTER_BITS) - 1)])
    at = np.minimum(np.searchsorted(table, values[some]), max(len(table) - 1, 0))
    return some[table[at] == values[some]] if len(table) else some[:0]


def _filter(table: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _FILTER_BITS, bool)
    out[table & np.uint64((1 << _FILTER_BITS) - 1)] = True
    return out


def _shingle_counts(texts: DataFrame, index: Index) -> dict[tuple[int, int], int]:
    """How often each shingle of the block begins in the documents."""
    tables = [(g, t) for g, t in index.tokens()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [_filter(t) for _, t in tables]
        totals = [np.zeros(len(t), np.int64) for _, t in tables]
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            for a, z in doc_slices(offsets):
                w = Words(data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a])
                for (g, table), f, total in zip(tables, filters, totals):
                    values = w.shingles(g)
                    total += np.bincount(np.searchsorted(table, values[_members(values, table, f)]), minlength=len(table))
        for (g, _), total in zip(tables, totals):
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, np.int32)), pa.array(at), pa.array(total[at])], ["g", "token", "n"])

    rows = in_arrow(texts.select("text"), count, "g int, token bigint, n bigint").groupBy("g", "token").agg(F.sum("n").alias("n"))
    return {(r["g"], r["token"]): r["n"] for r in rows.collect()}  # bounded by the block


def _hits(w: Words, index: Index, filters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First word and window of every occurrence in the texts of ``w``."""
    starts, units = [], []
    doc_of = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    for (g, table, unit, place), f in zip(index.parts, filters):
        values = w.shingles(g)
        at = _members(values, table, f)
        lo, hi = np.searchsorted(table, values[at]), np.searchsorted(table, values[at], side="right")
        n = hi - lo
        row = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        word = np.repeat(at, n)
        start, size = word - place[row], index.sizes[unit[row]]
        doc = doc_of[word]
        fits = (start >= w.first[doc]) & (start + size <= w.first[doc + 1])
        starts.append(start[fits])
        units.append(unit[row][fits])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, unit = np.concatenate(starts), np.concatenate(units)
    exact = [w.run(s, int(index.sizes[u])) == index.texts[u] for s, u in zip(start.tolist(), unit.tolist())]
    exact = np.array(exact, bool)
    return start[exact], unit[exact]


def scan(docs: DataFrame, index: Index, keep: list[str]) -> DataFrame:
    """``keep`` columns, n_words, the hit word runs and the hit items of each document."""
    schema = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [_filter(p[1]) for p in index.parts]
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            n_words, spans, items = [], [], []
            for a, z in doc_slices(offsets):
                w = Words(data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a])
                n_words += np.diff(w.first).tolist()
                found: list[dict] = [{} for _ in range(a, z)]
                start, unit = _hits(w, index, filters)
                doc = np.searchsorted(w.first, start, side="right") - 1
                for d, s, u in zip(doc.tolist(), start.tolist(), unit.tolist()):
                    found[d].setdefault(s - int(w.first[d]), []).append(u)
                for f in found:
                    spans.append(sorted((s, s + int(index.sizes[u])) for s, us in f.items() for u in us))
                    items.append(sorted({i for us in f.values() for u in us for i in index.items[u]}))
            yield pa.RecordBatch.from_arrays([
                *[b.column(c) for c in keep], pa.array(n_words, pa.int64()),
                pa.array([[x for s in ss for x in s] for ss in spans], pa.list_(pa.int64())),
                pa.array(items, pa.list_(pa.string()))], [*keep, "n_words", "spans", "items"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema)
    return in_arrow(docs.select(*keep, "text") if "text" not in keep else docs.select(*keep), run,
                    fields + "n_words bigint, spans array<bigint>, items array<string>")


def blocks_of(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[str, str]]]:
    """Blocks of items on the driver, each of a bounded number of characters (one item at least)."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_or_empty().alias("text"))
    held, size = [], 0
    for r in rows.toLocalIterator():
        n = len(r["text"]) + 1
        if held and size + n > block_chars:
            yield held
            held, size = [], 0
        held.append((r["item"], r["text"]))
        size += n
    yield held


def hit_columns(df: DataFrame) -> list:
    """n_hit, n_items, items_sha256 and contaminated from runs and items.

    Runs are [start, end) pairs by start; the hit words are those of their union.
    """
    pairs = F.transform(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), lambda i: F.struct(
        F.get("spans", i).alias("s"), F.get("spans", i + 1).alias("e")))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    union = F.aggregate(F.when(F.size("spans") > 0, pairs).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>")), start,
                        lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"),
                                              (a["n"] + F.greatest(x["e"] - F.greatest(a["end"], x["s"]), F.lit(0))).alias("n")), lambda a: a["n"])
    return [union.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated")]


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW,
                  block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``keep`` columns and the five result columns for each document."""
    source = docs.select(F.struct("*").alias("row"), text_or_empty().alias("text"))
    out, found = None, []
    for items in blocks_of(benchmark, block_chars):
        index = Index(items, window)
        index.keep_rarest(_shingle_counts(source, index))
        if out is not None or found:
            found.append(index)
        else:
            out, found = scan(source, index, ["row"]), [index]
    if len(found) > 1:
        digest = F.sha2("text", 256)
        hits = None
        for index in found:
            one = scan(source.select("text"), index, ["text"]).filter(F.size("items") > 0).select(
                digest.alias("digest"), "spans", "items").dropDuplicates(["digest"])
            hits = one if hits is None else hits.unionByName(one)
        spans = F.transform(F.flatten(F.collect_list(F.transform(
            F.filter(F.sequence(F.lit(0), F.size("spans") - 1), lambda i: i % 2 == 0),
            lambda i: F.struct(F.get("spans", i).alias("s"), F.get("spans", i + 1).alias("e"))))), lambda x: x)
        merged = hits.groupBy("digest").agg(F.array_sort(spans).alias("p"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        merged = merged.select("digest", F.flatten(F.transform("p", lambda x: F.array(x["s"], x["e"]))).alias("spans"), "items")
        every = scan(source, Index([], window), ["row", "text"]).select("row", "n_words", digest.alias("digest"))
        out = (every.join(merged, "digest", "left")
               .withColumn("spans", F.coalesce("spans", F.array().cast("array<bigint>")))
               .withColumn("items", F.coalesce("items", F.array().cast("array<string>"))))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], "n_words", *hit_columns(out))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs.select("doc_id", "text"), benchmark, ["doc_id"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark; same columns."""
    source = docs.select(F.struct("*").alias("row"), F.col("text"))
    return contamination(source, benchmark, ["row"]).filter(~F.col("contaminated")).select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT rid, n, i, array_to_string(w[i:i+n-1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), m AS (
  SELECT rid, n, i, item_id FROM dw JOIN bw USING (n, win)
), hit AS (
  SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM m) GROUP BY rid
), it AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""
