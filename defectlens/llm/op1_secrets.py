"""Secret scans (DataFrame functions only).

Three patterns give the base spans (assignments, access keys, hex strings).
The method adds long runs of key characters whose log-likelihood ratio under
two character Markov models, random strings against ordinary identifiers,
reaches a threshold.  Both models are bigram counts over 67 characters,
trained from labelled samples and smoothed by the class's single characters; the ratio is kept in
whole thousandths of a bit, so a score is an exact integer sum.

Labelled samples: random are the values that the base patterns find in all
texts (distinct, the first ``MAX_SAMPLES`` in md5 order) and
``GENERATED`` seeded digests in three alphabets; ordinary are the other words,
too short to be judged themselves, of the first ``SAMPLE_DOCS`` distinct ids in md5 order (null: an id; of a repeated
id the text with the least md5), distinct, the first ``MAX_SAMPLES`` in md5 order.  The bounds limit the fit only: every
document is scanned.

A text's spans are found without a growing accumulator (it would be copied at
each step): places are prefix sums in chunks of ``CHUNK``, overlaps come from
prefix maxima over the sorted spans, and texts are cut by byte offsets kept
beside the code points.

Edge cases: null text counts as empty; a text without a secret has empty
spans and the digest of the empty string; repeated rows are scanned one by
one; an empty table gives an empty result; other columns are carried by
:func:`redact` unchanged.  Positions are code points, the end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlens.llm.common import staged, text_or_empty

ASSIGN = ("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
          "[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Maximal runs judged by the model.
RUN_CHARS = "A-Za-z0-9+/_-"
MIN_RUN = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
KINDS = ("assign", "access", "hex", "markov")
SAMPLE_DOCS = 2000
MAX_SAMPLES = 50000
GENERATED = 2000
#: Pairs are smoothed by this many counts of the class's single characters; the least ratio in thousandths of a bit.
SMOOTHING = 20
THRESHOLD = 20000
MASK = "[REDACTED]"
#: Values that a prefix sum adds up directly; whole chunks are added up before.
CHUNK = 64
#: Start, kind, end (code points), matched text, start and end in bytes.
_SPAN = "array<struct<s:int,k:int,e:int,v:string,bs:int,be:int>>"


def _let(value: Column, body) -> Column:
    """``body`` over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _before(values: Column, op) -> Column:
    """For each of an array of integers, ``op`` over those before it (0 for the first)."""
    fold = lambda x: F.aggregate(x, F.lit(0), lambda a, b: op(a, b))

    def placed(v: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int"))
        totals = F.transform(chunks, lambda c: fold(F.slice(v, c * CHUNK + 1, F.lit(CHUNK))))
        starts = _let(totals, lambda t: F.transform(chunks, lambda c: fold(F.slice(t, F.lit(1), c))))
        at = lambda i: F.floor(i / CHUNK).cast("int")
        return _let(starts, lambda st: F.transform(v, lambda x, i: op(
            F.get(st, at(i)), fold(F.slice(v, at(i) * CHUNK + 1, i % CHUNK)))))

    return _let(values, lambda v: F.when(F.size(v) > 0, placed(v)).otherwise(F.array().cast("array<int>")))


def _add(a: Column, b: Column) -> Column:
    return a + b


def _spans(t: Column, pattern: str, kind: int, keep) -> Column:
    """Leftmost matches of ``pattern`` that ``keep`` accepts, with positions.

    The pieces between the matches and the matches themselves add up to the
    text; their running length gives each start.
    """
    parts = F.filter(F.zip_with(F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(
        F.length(gap).alias("gap"), F.octet_length(gap).alias("bytes"), hit.alias("hit"),
        F.length(hit).alias("n"), F.octet_length(hit).alias("nb"))), lambda x: x["hit"].isNotNull())

    def spans(p: Column) -> Column:
        chars, octets = _before(F.transform(p, lambda x: x["gap"] + x["n"]), _add), _before(F.transform(p, lambda x: x["bytes"] + x["nb"]), _add)
        at = F.arrays_zip(p.alias("p"), chars.alias("c"), octets.alias("o"))

        def span(x: Column) -> Column:
            s, bs = x["c"] + x["p"]["gap"], x["o"] + x["p"]["bytes"]
            return F.struct(s.alias("s"), F.lit(kind).alias("k"), (s + x["p"]["n"]).alias("e"), x["p"]["hit"].alias("v"),
                            bs.alias("bs"), (bs + x["p"]["nb"]).alias("be"))

        return F.filter(F.transform(at, span), lambda x: keep(x["v"]))

    return _let(parts, spans)


def base_spans(t: Column) -> Column:
    """The spans of the three patterns, by start and then kind."""
    none = F.array().cast(_SPAN)
    assign = F.when(t.rlike(ASSIGN), _spans(t, ASSIGN, 0, lambda v: F.length(_value(v)) >= MIN_VALUE)).otherwise(none)
    access = F.when(t.contains("AKIA"), _spans(t, ACCESS, 1, lambda v: F.length(v) >= MIN_ACCESS)).otherwise(none)
    # maximal runs, so the least length can stand in the pattern
    long_hex = f"[0-9a-f]{{{MIN_HEX},}}"
    hexes = F.when(t.rlike(long_hex), _spans(t, long_hex, 2, lambda v: F.lit(True))).otherwise(none)
    return F.array_sort(F.concat(assign, access, hexes))


def _value(match: Column) -> Column:
    return F.regexp_extract(match, ASSIGN, 2)


def run_spans(t: Column) -> Column:
    """Maximal runs of key characters that are long enough to be judged."""
    pattern = f"(?<![{RUN_CHARS}])[{RUN_CHARS}]{{{MIN_RUN},}}"
    return F.when(t.rlike(pattern), _spans(t, pattern, 3, lambda v: F.lit(True))).otherwise(F.array().cast(_SPAN))


def generated_samples(spark, n: int = GENERATED) -> DataFrame:
    """Seeded random strings: hex, mixed-case and upper-case digests."""
    digest = F.sha2(F.concat(F.lit("random string "), F.col("id").cast("string")), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    kinds = F.array(digest, mixed, F.upper(F.regexp_replace(mixed, "[+/]", "")))
    return spark.range(n).select(F.explode(kinds).alias("value"), F.lit(1).alias("label"))


def first_by_digest(df: DataFrame, digest: str, limit: int, n: int) -> DataFrame:
    """The ``limit`` rows with the smallest md5 digests.

    A digest below twice the expected bound is asked first, so that the tasks
    send a few rows each to the one that orders them, however many there are.
    """
    share = min(1.0, 2.0 * limit / max(n, 1)) if n > 2 * limit else 1.0
    if share < 1.0:
        df = df.filter(F.col(digest) < F.lit(format(int(share * (1 << 32)), "08x")))
    return df.orderBy(digest).limit(limit)


def some_ids(texts: DataFrame, n: int) -> DataFrame:
    """One text of each of the first ``SAMPLE_DOCS`` of ``n`` distinct id digests ``o``."""
    share = min(1.0, 2.0 * SAMPLE_DOCS / max(n, 1)) if n > 2 * SAMPLE_DOCS else 1.0
    if share < 1.0:
        texts = texts.filter(F.col("o") < F.lit(format(int(share * (1 << 32)), "08x")))
    one = texts.groupBy("o").agg(F.min_by("t", F.md5(F.col("t").cast("binary"))).alias("t"))
    return one.orderBy("o").limit(SAMPLE_DOCS)


def labelled_samples(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """(value, label): see the module's text for where they come from."""
    found = (scanned.select(F.explode("base").alias("x"))
             .select(F.when(F.col("x.k") == 0, _value(F.col("x.v"))).otherwise(F.col("x.v")).alias("value"))
             .distinct().withColumn("o", F.md5(F.col("value").cast("binary"))))
    found = first_by_digest(found, "o", MAX_SAMPLES, found.count()).drop("o")
    some = docs.select(text_or_empty().alias("t"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("o"))
    some = some_ids(some, some.select("o").distinct().count())
    words = (some.select(F.explode(F.regexp_extract_all("t", F.lit(f"[{RUN_CHARS}]+"), F.lit(0))).alias("value"))
             .filter(F.length("value").between(4, MIN_RUN - 1)).distinct()
             .join(found, "value", "left_anti").orderBy(F.md5(F.col("value").cast("binary"))).limit(MAX_SAMPLES))
    return (found.withColumn("label", F.lit(1)).unionByName(words.withColumn("label", F.lit(0)))
            .unionByName(generated_samples(docs.sparkSession)))


def train(samples: DataFrame) -> DataFrame:
    """One row: ``w``, the ratio of each character pair in thousandths of a bit.

    ``samples`` has value and label (1 random, 0 ordinary).  Index of a pair:
    first * 67 + second, 67 characters, in the order of ``ALPHABET``.
    """
    n = len(ALPHABET)
    at = lambda c: F.locate(c, F.lit(ALPHABET)) - 1 if isinstance(c, str) else F.instr(F.lit(ALPHABET), c) - 1
    chars = samples.filter(F.length("value") >= 2).select("label", F.transform(
        F.split("value", ""), lambda c: at(c)).alias("c"))
    pairs = (chars.select("label", F.explode(F.transform(
        F.slice("c", 1, F.size("c") - 1), lambda x, i: F.struct(x.alias("a"), F.get("c", i + 1).alias("b")))).alias("p"))
        .select("label", "p.*").filter((F.col("a") >= 0) & (F.col("b") >= 0))
        .groupBy("label", "a", "b").agg(F.count("*").alias("n")))
    # At most 2 * 67 * 67 rows from here on.
    cells = pairs.groupBy("a", "b").agg(*[F.sum(F.when(F.col("label") == k, F.col("n"))).alias(f"n{k}") for k in (0, 1)])
    firsts = pairs.groupBy("a").agg(*[F.sum(F.when(F.col("label") == k, F.col("n"))).alias(f"t{k}") for k in (0, 1)])
    seconds = pairs.groupBy("b").agg(*[F.sum(F.when(F.col("label") == k, F.col("n"))).alias(f"u{k}") for k in (0, 1)])
    total = pairs.agg(F.struct(*[F.sum(F.when(F.col("label") == k, F.col("n"))).alias(f"s{k}") for k in (0, 1)]).alias("s"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    grid = (samples.sparkSession.range(n * n).select((F.col("id") / n).cast("int").alias("a"), (F.col("id") % n).cast("int").alias("b"))
            .join(cells, ["a", "b"], "left").join(firsts, "a", "left").join(seconds, "b", "left").withColumn("s", total.scalar()))
    single = lambda k: (zero(f"u{k}") + 0.5) / (zero(f"s.s{k}") + 0.5 * n)
    log = lambda k: F.log2((zero(f"n{k}") + SMOOTHING * single(k)) / (zero(f"t{k}") + SMOOTHING))
    weight = F.floor(F.lit(1000) * (log(1) - log(0)) + F.lit(0.5)).cast("long")
    return (grid.select((F.col("a") * n + F.col("b")).alias("i"), weight.alias("w"))
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("w")))


def ratio(value: Column, weights: Column) -> Column:
    """Log-likelihood ratio of a run, random against ordinary."""
    n = len(ALPHABET)
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return _let(codes, lambda c: F.aggregate(
        F.sequence(F.lit(1), F.length(value) - 1), F.lit(0).cast("long"),
        lambda s, i: s + F.element_at(weights, F.get(c, i - 1) * n + F.get(c, i) + 1)))


def _apart(runs: Column, base: Column) -> Column:
    """The runs that no base span overlaps, by one sweep over both in the order of their starts.

    Runs lie apart from each other, so a span that starts inside a run comes
    right after it; one that starts before reaches into it if the furthest end
    so far does.
    """
    def sweep(both: Column) -> Column:
        reach = _before(F.transform(both, lambda x: F.when(x["k"] < 3, x["e"]).otherwise(0)), F.greatest)
        follows = F.transform(both, lambda x, i: F.get(both, i + 1))
        seen = F.arrays_zip(both.alias("x"), reach.alias("reach"), follows.alias("next"))
        hit = lambda p: ((p["reach"] > p["x"]["s"])
                         | F.coalesce((p["next"]["k"] < 3) & (p["next"]["s"] < p["x"]["e"]), F.lit(False)))
        return F.transform(F.filter(seen, lambda p: (p["x"]["k"] == 3) & ~hit(p)), lambda p: p["x"])

    return _let(F.array_sort(F.concat(base, runs)), sweep)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all input columns), ``base`` spans and ``runs`` to be judged."""
    t = text_or_empty(text)
    return (docs.select(F.struct("*").alias("row"), base_spans(t).alias("base"), run_spans(t).alias("runs0"))
            .withColumn("runs", F.when((F.size("runs0") > 0) & (F.size("base") > 0), _apart(F.col("runs0"), F.col("base")))
                        .otherwise(F.col("runs0"))).drop("runs0"))


def all_spans(scanned: DataFrame, model: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``spans``: the base spans and the runs whose ratio reaches the threshold."""
    # a scalar subquery: one row of a bounded size, no join
    df = scanned.withColumn("w", F.when(F.size("runs") > 0, model.scalar()))
    found = F.filter("runs", lambda r: ratio(r["v"], F.col("w")) >= threshold)
    return df.withColumn("spans", F.when(F.size("runs") > 0, F.array_sort(F.concat("base", found))).otherwise(F.col("base"))).drop("w")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans per document (the contract's columns)."""
    docs = docs.select("doc_id", "text")
    scanned = staged(scan(docs).select(F.col("row.doc_id").alias("doc_id"), "base", "runs"), "secrets")
    model = staged(train(labelled_samples(docs, scanned)), "secret-model")
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return all_spans(scanned, model).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every found span masked; overlapping spans get one mask."""
    full = staged(scan(docs, text), "secrets")
    plain = full.select(F.col("row.doc_id").alias("doc_id"), F.col(f"row.`{text}`").alias("text"))
    model = staged(train(labelled_samples(plain, full)), "secret-model")
    df = all_spans(full, model)
    t = F.col(f"row.`{text}`")

    def masked_text(raw: Column) -> Column:
        ends = _before(F.transform("spans", lambda x: x["be"]), F.greatest)
        cut = F.arrays_zip(F.col("spans").alias("x"), ends.alias("at"))
        piece = lambda p: F.concat(F.substring(raw, p["at"] + 1, p["x"]["bs"] - p["at"]).cast("string"), F.lit(MASK))
        pieces = F.transform(F.filter(cut, lambda p: p["x"]["bs"] >= p["at"]), piece)
        last = F.array_max(F.transform("spans", lambda x: x["be"]))
        return F.concat(F.array_join(pieces, ""), F.substring(raw, last + 1, F.octet_length(raw)).cast("string"))

    masked = _let(t.cast("binary"), masked_text)
    return df.select(*[F.when(F.size("spans") > 0, masked).otherwise(t).alias(c) if c == text
                       else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), m0 AS (
  SELECT rid, 0 AS k, string_split_regex(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS g,
    regexp_extract_all(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS h FROM d
  UNION ALL SELECT rid, 1, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT rid, 2, string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+') FROM d
  UNION ALL SELECT rid, 3, string_split_regex(t, '[A-Za-z0-9+/_-]+'), regexp_extract_all(t, '[A-Za-z0-9+/_-]+') FROM d
), m1 AS (
  SELECT rid, k, unnest(range(1, len(h) + 1)) AS i, unnest(list_transform(g[1:len(h)], lambda x: length(x))) AS gap, unnest(h) AS v FROM m0
), m2 AS (
  SELECT rid, k, v, sum(gap + length(v)) OVER (PARTITION BY rid, k ORDER BY i) AS e FROM m1
), sp AS (
  SELECT rid, k, (e - length(v))::BIGINT AS s, e::BIGINT AS e, v,
    CASE WHEN k = 0 THEN regexp_extract(v, '["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1) ELSE v END AS val
  FROM m2
), base AS (
  SELECT * FROM sp WHERE (k = 0 AND length(val) >= 6) OR (k = 1 AND length(v) >= 20) OR (k = 2 AND length(v) >= 24)
), runs AS (
  SELECT * FROM sp r WHERE k = 3 AND length(v) >= 20
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = r.rid AND b.s < r.e AND r.s < b.e)
), found AS (
  SELECT DISTINCT val AS v FROM base ORDER BY md5(val) LIMIT 50000
), chosen AS (
  SELECT arg_min(t, md5(t)) AS t FROM d GROUP BY md5(coalesce(doc_id::VARCHAR, '')) ORDER BY md5(coalesce(doc_id::VARCHAR, '')) LIMIT 2000
), words AS (
  SELECT v FROM (SELECT DISTINCT unnest(regexp_extract_all(t, '[A-Za-z0-9+/_-]+')) AS v FROM chosen)
  WHERE length(v) BETWEEN 4 AND 19 AND v NOT IN (SELECT v FROM found) ORDER BY md5(v) LIMIT 50000
), gen AS (
  SELECT sha256('random string ' || i::VARCHAR) AS hx FROM range(2000) r(i)
), mixed AS (
  SELECT hx, replace(base64(unhex(hx)), '=', '') AS b FROM gen
), samples AS (
  SELECT v, 1 AS label FROM found UNION ALL SELECT v, 0 FROM words UNION ALL SELECT hx, 1 FROM mixed
  UNION ALL SELECT b, 1 FROM mixed UNION ALL SELECT upper(regexp_replace(b, '[+/]', '', 'g')), 1 FROM mixed
), al AS (
  SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=' AS s
), pairs AS (
  SELECT label, strpos(s, v[i:i]) - 1 AS a, strpos(s, v[i+1:i+1]) - 1 AS b, count(*) AS n
  FROM (SELECT label, v, unnest(range(1, length(v))) AS i FROM samples), al GROUP BY ALL
), known AS (
  SELECT * FROM pairs WHERE a >= 0 AND b >= 0
), totals AS (
  SELECT label, a, sum(n) AS t FROM known GROUP BY ALL
), seconds AS (
  SELECT label, b, sum(n) AS u FROM known GROUP BY ALL
), sums AS (
  SELECT coalesce(sum(n) FILTER (label = 0), 0) AS s0, coalesce(sum(n) FILTER (label = 1), 0) AS s1 FROM known
), grid AS (
  SELECT x.a, y.b, coalesce(n0.n, 0) AS n0, coalesce(n1.n, 0) AS n1, coalesce(t0.t, 0) AS t0, coalesce(t1.t, 0) AS t1,
    (coalesce(u0.u, 0) + 0.5::DOUBLE) / (s0 + 33.5::DOUBLE) AS p0, (coalesce(u1.u, 0) + 0.5::DOUBLE) / (s1 + 33.5::DOUBLE) AS p1
  FROM range(67) x(a), range(67) y(b), sums
  LEFT JOIN known n0 ON n0.label = 0 AND n0.a = x.a AND n0.b = y.b LEFT JOIN known n1 ON n1.label = 1 AND n1.a = x.a AND n1.b = y.b
  LEFT JOIN totals t0 ON t0.label = 0 AND t0.a = x.a LEFT JOIN totals t1 ON t1.label = 1 AND t1.a = x.a
  LEFT JOIN seconds u0 ON u0.label = 0 AND u0.b = y.b LEFT JOIN seconds u1 ON u1.label = 1 AND u1.b = y.b
), model AS (
  SELECT a, b, floor(1000 * (log2((n1 + 20 * p1) / (t1 + 20)) - log2((n0 + 20 * p0) / (t0 + 20))) + 0.5)::BIGINT AS w FROM grid
), scored AS (
  SELECT r.rid, r.s, r.e, sum(w) AS score
  FROM (SELECT rid, s, e, v, unnest(range(1, length(v))) AS i FROM runs) r, al, model
  WHERE a = strpos(al.s, r.v[i:i]) - 1 AND b = strpos(al.s, r.v[i+1:i+1]) - 1 GROUP BY ALL
), every AS (
  SELECT rid, k, s, e FROM base UNION ALL SELECT rid, 3, s, e FROM scored WHERE score >= 20000
), lines AS (
  SELECT rid, k, s, ['assign', 'access', 'hex', 'markov'][k + 1] || ':' || s || ':' || e AS x FROM every
), agg AS (
  SELECT rid, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
    string_agg(x, ',' ORDER BY s, k) FILTER (k < 3) AS b, string_agg(x, ',' ORDER BY s, k) AS all_x FROM lines GROUP BY rid
)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(all_x, '') AS spans
FROM d LEFT JOIN agg USING (rid)
"""
