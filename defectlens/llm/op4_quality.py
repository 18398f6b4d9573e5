"""Quality rules, line first (DataFrame functions only).

Every line is judged by three rules, failing lines are removed, and a document
that loses too large a part of its word characters is rejected:

* punctuation: symbols ``#*$%&|<>`` are more than a tenth of the line's word
  characters, or there are four or more ``!``/``?`` and they are more than a
  tenth of them;
* navigation: three or more separators (a bar, a bullet, a guillemet between
  spaces);
* boilerplate: the line holds one of the listed phrases (any case; "released
  under the" only in a line that names a licence) and has fewer than
  ``SHORT_WORDS`` words, or the phrases are at least half of its word
  characters.  A longer line that mentions a phrase is content.

All patterns run in time linear in the line, however long its words are.

Edge cases: null text counts as empty; lines without a word are left alone
and weigh nothing; a document without words has n_words = 0 and fails the
base rule; repeated rows are judged one by one; an empty table gives an empty
result; columns of any other name are carried by :func:`keep_clean` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlens.llm.common import text_or_empty

SPACES = "[ \\t-\\r]+"
SYMBOLS = "[#*$%&|<>]"
SEPARATORS = "[ \\t][|\u2022\u00b7\u00bb][ \\t]"
_LICENCE = "licen[cs]es?|[al]?gpl|mit|bsd|apache|creative commons|public domain"
_PHRASES = ("all rights reserved|licensed under|this work is licensed|cookie policy|privacy policy|terms of use|terms of service|"
            "click here|sign up|log in")
_RELEASED = "released under the"
LICENCE = f"(?<![a-z])(?:{_LICENCE})(?![a-z])"
PHRASES = f"(?<![a-z])(?:{_PHRASES})(?![a-z])"
LICENCE_PHRASES = f"(?<![a-z])(?:{_PHRASES}|{_RELEASED})(?![a-z])"
SHORT_WORDS = 20
PHRASE_PERCENT = 50
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOL_PERCENT = 10
MARKS = 4
MARK_PERCENT = 10
MIN_SEPARATORS = 3
MAX_LOST_PERCENT = 50


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def _solid(c: Column) -> Column:
    """Characters that are not ASCII white space."""
    return F.length(c) - _count(c, "[ \\t-\\r]")


def line_fails(line: Column) -> Column:
    """Verdict of the three line rules; lines without a word pass."""
    solid = _solid(line)
    symbols = _count(line, SYMBOLS)
    marks = _count(line, "[!?]")
    punctuation = (((symbols > 0) & (symbols * 100 > solid * SYMBOL_PERCENT))
                   | ((marks >= MARKS) & (marks * 100 > solid * MARK_PERCENT)))
    navigation = _count(line, SEPARATORS) >= MIN_SEPARATORS
    low = F.lower(line)
    found = F.when(low.contains(_RELEASED) & low.rlike(LICENCE), F.regexp_replace(low, LICENCE_PHRASES, " ")).otherwise(
        F.regexp_replace(low, PHRASES, " "))
    few = _count(line, "[^ \\t-\\r]+") < SHORT_WORDS
    named = low.rlike(LICENCE_PHRASES)  # asked first: most lines hold no phrase
    boilerplate = named & (found != low) & (few | ((_solid(low) - _solid(found)) * 100 >= _solid(low) * PHRASE_PERCENT))
    return punctuation | navigation | boilerplate  # each needs a word character


def _ranked(h: Column) -> Column:
    """Window fingerprints with their places, sorted: equal ones are neighbours."""
    return F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all input columns) with the base counts and the verdict."""
    df = docs.select(F.struct("*").alias("row"), text_or_empty(text).alias("t"))
    df = df.withColumn("words", F.array_remove(F.split("t", SPACES, -1), F.lit("")))
    df = df.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike("[^ \\t-\\r]")))
    df = df.withColumn("wh", F.transform("words", lambda x: F.xxhash64(x)))
    n = F.size("words")
    df = df.withColumn("h", F.when(n >= WINDOW, F.transform(
        F.slice("wh", 1, n - (WINDOW - 1)),
        lambda x, i: F.xxhash64(x, *[F.get("wh", i + k) for k in range(1, WINDOW)]))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("repeats", F.size(F.array_distinct("h")) < F.size("h"))
    df = df.withColumn("ranked", F.when(F.col("repeats"), _ranked(F.col("h"))))
    # the places of windows found twice, in order: each covers eight words less the overlap with the next
    df = df.withColumn("at", F.when(F.col("repeats"), F.sort_array(F.transform(
        F.filter("ranked", lambda x, i: ((i > 0) & (x["h"] == F.get("ranked", i - 1)["h"]))
                 | F.coalesce(x["h"] == F.get("ranked", i + 1)["h"], F.lit(False))),
        lambda x: x["i"]))))
    covered = F.aggregate(
        F.transform("at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x)
    df = df.withColumn("failing", F.filter("lines", line_fails))
    df = df.withColumn("lost", _solid(F.array_join("failing", "")))
    df = df.select(
        "row", "t",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("repeats"), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.col("lost").cast("long").alias("lost_chars"))
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                       | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    return df.withColumn("kept", ~F.col("base_failed")
                         & (F.col("lost_chars") * 100 <= F.col("word_chars") * MAX_LOST_PERCENT))


def cleaned(text: Column) -> Column:
    """The text without the lines that fail; its other lines are unchanged."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~line_fails(x)), "\n")


def keep_clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that the rules keep, failing lines removed; same columns."""
    df = judged(docs, text)
    fields = [F.when(F.col("lost_chars") > 0, cleaned(F.col("t"))).otherwise(F.col(f"row.`{c}`")).alias(c)
              if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    # a generator, not a filter: a filter would be moved below the projections and their steps computed again inside it
    return df.select(F.inline(F.when(F.col("kept"), F.array(F.struct(*fields)))))


def quality_report(docs: DataFrame) -> DataFrame:
    return judged(docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "lost_chars")


# Neither engine's longest common pattern language looks around, so the SQL doubles every character but
# a-z: a phrase may then take one copy on each side and leaves the other to its neighbours.
_DOUBLED = (_PHRASES + "|" + _RELEASED).replace(" ", "  ")
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d
), win AS (
  SELECT rid, i, array_to_string(words[i:i+7], ' ') AS win
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), dup AS (
  SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, win) > 1
), hit AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(range(0, 8)) AS k) GROUP BY rid
), ln AS (
  SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d
), solid AS (
  SELECT rid, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS n_solid,
    length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS n_sym,
    length(line) - length(regexp_replace(line, '[!?]', '', 'g')) AS n_mark,
    len(regexp_extract_all(line, '[ \t][|•·»][ \t]')) AS n_sep,
    length(regexp_replace(lower(line), '[\x20\x09-\x0D]', '', 'g')) AS low_solid, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n_line_words,
    list_filter(regexp_extract_all(' ' || regexp_replace(lower(line), '([^a-z])', '\1\1', 'g') || ' ', '[^a-z](@doubled)[^a-z]', 1),
      lambda p: p <> 'released  under  the' OR regexp_matches(lower(line), '(?:^|[^a-z])(?:@licence)(?:$|[^a-z])')) AS phrases
  FROM ln
), lines AS (
  SELECT *, len(phrases) > 0 AND (n_line_words < 20
    OR length(replace(array_to_string(phrases, ''), ' ', '')) * 100 >= low_solid * 50) AS phrase FROM solid
), l AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup,
    sum(CASE WHEN n_sym * 100 > n_solid * 10 OR (n_mark >= 4 AND n_mark * 100 > n_solid * 10)
              OR n_sep >= 3 OR phrase THEN n_solid ELSE 0 END) AS lost
  FROM lines WHERE n_solid > 0 GROUP BY rid
), m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(l.n_dup, 0)::BIGINT AS n_dup_lines, coalesce(hit.n, 0)::BIGINT AS n_repeat_words,
    coalesce(l.lost, 0)::BIGINT AS lost_chars
  FROM w LEFT JOIN hit USING (rid) LEFT JOIN l USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars,
  (n_words < 20 OR n_repeat_words * 100 > n_words * 30) AS base_failed,
  NOT (n_words < 20 OR n_repeat_words * 100 > n_words * 30) AND lost_chars * 100 <= word_chars * 50 AS kept
FROM m
""".replace("@doubled", _DOUBLED).replace("@licence", _LICENCE)
