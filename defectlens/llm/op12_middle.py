"""Fill-in-middle transformation by a piecewise-linear learned rank index.

A cut is given in code points, a text is stored in UTF-8 bytes.  ``RankIndex``
learns where every code point starts: straight segments, each within
``error`` bytes of all its boundary offsets, plus one stored residual a
boundary.  A cut is predicted by its segment and put right by its residual,
so it is exact; a text of one-byte characters is one segment.  Segments are
found left to right by the narrowing range of slopes that still fit (chunks
grow, so a segment costs in proportion to its length).

Cuts and form come from the digest of ``seed:doc_id``: the result does not
depend on partitions or order, and repeated rows give equal results.  A null
text is empty, an empty text is plain; a null doc_id is digested as an empty
one.  A text that holds a sentinel is left plain, so a marked text can be
rebuilt exactly.  Further input columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlens.llm.common import in_arrow, text_or_empty

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Bytes that a segment may be off before its residual is added; a residual fits one signed byte.
ERROR = 32

#: Longest chunk of boundaries looked at together.
CHUNK = 1 << 16

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, segments int"


class RankIndex:
    """Byte offsets of the boundaries 0..n of a text, as segments and residuals."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        if not 1 <= error <= 100:
            raise ValueError("error must be 1 to 100, so that a residual fits a signed byte")
        first, base, slope, residual = [], [], [], np.empty(len(offsets), np.int8)
        at = 0
        while at < len(offsets):
            end, a = self._segment(offsets, at, error)
            guess = offsets[at] + np.floor(a * np.arange(end - at)).astype(np.int64)
            residual[at:end] = offsets[at:end] - guess
            first.append(at)
            base.append(int(offsets[at]))
            slope.append(a)
            at = end
        self.first, self.base, self.slope = np.array(first, np.int64), np.array(base, np.int64), np.array(slope)
        self.residual = residual

    @staticmethod
    def _segment(y: np.ndarray, start: int, error: int) -> tuple[int, float]:
        """End and slope of the longest segment from ``start`` that stays within ``error``."""
        low, high, at, width = -np.inf, np.inf, start + 1, 512
        while at < len(y):
            stop = min(at + width, len(y))
            x, rise = np.arange(at - start, stop - start), y[at:stop] - y[start]
            lows = np.maximum(np.maximum.accumulate((rise - error) / x), low)
            highs = np.minimum(np.minimum.accumulate((rise + error) / x), high)
            bad = np.flatnonzero(lows > highs)
            if len(bad):
                k = int(bad[0])
                if k:
                    low, high = lows[k - 1], highs[k - 1]
                at += k
                break
            low, high, at, width = lows[-1], highs[-1], stop, min(2 * width, CHUNK)
        return at, float((low + high) / 2) if at > start + 1 else 1.0

    def offset(self, rank: int) -> int:
        """Byte offset of a boundary: predicted, then corrected."""
        s = int(np.searchsorted(self.first, rank, "right")) - 1
        return int(self.base[s] + np.floor(self.slope[s] * (rank - self.first[s])) + self.residual[rank])


def boundaries(data: np.ndarray) -> np.ndarray:
    """Byte offsets at which a code point of the UTF-8 text starts, and its end."""
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def draws(seed: int, doc_id: int | None) -> list[int]:
    """The first four 32-bit numbers of the document's digest."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i:i + 8], 16) for i in range(0, 32, 8)]


def transform(doc_id: int | None, data: bytes, seed: int, plain_from: int, suffix_first: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output, segments) of one text."""
    offsets = boundaries(np.frombuffer(data, np.uint8))
    n = len(offsets) - 1
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not n or h3 % 100 >= plain_from or any(m.encode() in data for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, data, 0
    index = RankIndex(offsets)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = index.offset(a), index.offset(b)
    prefix, middle, suffix = data[:i], data[i:j], data[j:]
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, b"".join((s, suffix, p, prefix, m, middle)), len(index.first)
    return n, "psm", a, b - a, b"".join((p, prefix, s, suffix, m, middle)), len(index.first)


def _transform_batches(batches: Iterator[pa.RecordBatch], seed: int, plain_from: int, suffix_first: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        ids = batch.column("doc_id").to_pylist()
        rows = [transform(i, t.as_py(), seed, plain_from, suffix_first) for i, t in zip(ids, texts)]
        n, form, prefix, middle, output, segments = zip(*rows) if rows else ([],) * 6
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                               pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                               pa.array(output, pa.binary()).cast(pa.string()), pa.array(segments, pa.int32())],
                              names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "segments"])


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, suffix_first_percent: int = 20) -> DataFrame:
    """``docs`` (doc_id, text) to their training form.

    Rows: doc_id, n (code points), form (plain, psm, spm), prefix_chars,
    middle_chars (null if plain), output (the text) and segments (of the rank
    index; 0 if plain).  One pass without a shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return in_arrow(rows, partial(_transform_batches, seed=seed, plain_from=100 - plain_percent, suffix_first=suffix_first_percent), SCHEMA)


def restore(output: Column, form: Column) -> Column:
    """The text of a training form.  A text that was marked held no mark, so each mark's first place is its only one."""
    width = len(PREFIX)
    p, s, m = (F.instr(output, x) for x in (PREFIX, SUFFIX, MIDDLE))
    middle = F.substr(output, m + width)
    psm = F.concat(F.substr(output, F.lit(width + 1), s - width - 1), middle, F.substr(output, s + width, m - s - width))
    spm = F.concat(F.substr(output, p + width, m - p - width), middle, F.substr(output, F.lit(width + 1), p - width - 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def middle_report(docs: DataFrame) -> DataFrame:
    """Contract columns: the cuts and the digests of output and restored text."""
    rows = fill_in_middle(docs)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2(F.col("output"), 256).alias("output_sha256"),
                       F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def _draw(i: int) -> str:
    return f"CAST('0x' || substr(d, {8 * i + 1}, 8) AS BIGINT)"


ORACLE = f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
), cuts AS (
  SELECT *, least({_draw(0)} % (n + 1), {_draw(1)} % (n + 1)) AS a, greatest({_draw(0)} % (n + 1), {_draw(1)} % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_draw(2)} % 100 >= 90 THEN 'plain'
              WHEN {_draw(3)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM texts
), parts AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1, n - b) AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE WHEN form = 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM parts"""
