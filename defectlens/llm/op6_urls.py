"""URL filters: rules first, gradient-boosted trees for the rest (DataFrame functions only).

Rules are host and path prefixes; the longest that fits decides.  Other urls
are judged by boosted trees (logistic loss, depth ``DEPTH``) on lexical
features: lengths, path depth, digit ratio, character entropy, parameter
counts, hyphens and host labels, and the block rate of the host's suffix among
the labelled urls.

Training: the labelled urls are made distinct, each (url, label) with its
number of rows as weight; at most ``MAX_LABELLED`` of these (the first in md5
order of the url; the bound limits the fit only) are binned once.  Each level of a
tree is one aggregation by (node, feature, bin) and a window over the bins
that finds the best split, so a level sends at most 2^depth rows to the
driver.  Gradients are whole millionths, so sums and splits do not depend on
the order of rows.

Without labels of their own (argument ``labelled``), :func:`seed_labels` marks
urls by words in the host; the words themselves are no feature.
:func:`held_out` fits on four fifths of labelled urls and counts the verdicts
on the rest.

Edge cases: a null url or one without ``://`` has an empty host and path, fits
no rule and is judged on its (empty) features; repeated rows are judged one by
one; with no labelled url, or one class only, the model is that class (none:
allow); an empty table gives an empty result; other columns are carried by
:func:`keep_allowed` unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from defectlens.llm.common import staged

#: (host, path prefix, verdict), fixed values of the query.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
SEED_WORDS = "spam|pills|casino|cheap|viagra|porn|adult|xxx|lottery|bets|betting|payday|ads-|banner"
MAX_LABELLED = 20_000
TREES, DEPTH, RATE, BINS = 12, 3, 0.4, 16
MIN_WEIGHT = 1.0
PRIOR = 20
SCALE = 1_000_000
FEATURES = ("url_length", "host_length", "path_depth", "digit_permille", "entropy_milli", "host_entropy_milli",
            "n_params", "n_hyphens", "n_labels", "suffix_permille")


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """host (A-Z lower-cased), path and what follows the path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return host, path, F.regexp_extract(rest, "(?s)^[^?#]*(.*)$", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(s: Column) -> Column:
    """Character entropy in thousandths of a bit."""
    n = F.length(s)
    counts = F.transform(F.array_distinct(F.split(s, "")), lambda c: n - F.length(F.replace(s, c, F.lit(""))))
    bits = F.aggregate(counts, F.lit(0.0), lambda a, k: a - F.when(k > 0, k / n * F.log2(k / n)).otherwise(F.lit(0.0)))
    return F.when(n > 0, F.floor(bits * 1000 + 0.5)).otherwise(F.lit(0)).cast("int")


def _count(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern))


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """``row`` (all input columns), host, path, suffix and the features of the url itself."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    host, path, tail = url_parts(F.col("u"))
    df = urls.select(F.struct("*").alias("row"), u.alias("u")).select("row", "u", host.alias("host"), path.alias("path"), tail.alias("tail"))
    n = F.length("u")
    return df.select(
        "row", "u", "host", "path", F.substring_index("host", ".", -1).alias("suffix"),
        n.alias("url_length"), F.length("host").alias("host_length"), _count(F.col("path"), "/").alias("path_depth"),
        F.when(n > 0, F.floor(_count(F.col("u"), "[0-9]") * 1000 / n)).otherwise(F.lit(0)).cast("int").alias("digit_permille"),
        _entropy(F.col("u")).alias("entropy_milli"), _entropy(F.col("host")).alias("host_entropy_milli"),
        _count(F.col("tail"), "=").alias("n_params"), _count(F.col("host"), "-").alias("n_hyphens"),
        (_count(F.col("host"), "[.]") + 1).alias("n_labels"))


def seed_labels(urls: DataFrame) -> DataFrame:
    """(url, label): 1 where the host holds a seed word."""
    host, _, _ = url_parts(F.coalesce("url", F.lit("")))
    return urls.select("url", host.rlike(SEED_WORDS).cast("int").alias("label"))


class Trees:
    """Fitted trees: splits by node, leaf values, and the suffix rates as a table."""

    def __init__(self, bias: float, trees: list[dict], suffixes: DataFrame, prior: int):
        self.bias, self.trees, self.suffixes, self.prior = bias, trees, suffixes, prior

    def with_suffix(self, features: DataFrame) -> DataFrame:
        return (features.join(self.suffixes, "suffix", "left")
                .withColumn("suffix_permille", F.coalesce("suffix_permille", F.lit(self.prior))))

    def margin(self) -> Column:
        return sum((_tree_value(t) for t in self.trees), F.lit(self.bias))


def _node(tree: dict) -> Column:
    """Number of the node a row has reached (children of k: 2k and 2k + 1)."""
    def walk(k: int) -> Column:
        if k not in tree["splits"]:
            return F.lit(k)
        feature, threshold = tree["splits"][k]
        return F.when(F.col(feature) <= threshold, walk(2 * k)).otherwise(walk(2 * k + 1))
    return walk(1)


def _tree_value(tree: dict) -> Column:
    def walk(k: int) -> Column:
        if k not in tree["splits"]:
            return F.lit(tree["values"].get(k, 0.0))
        feature, threshold = tree["splits"][k]
        return F.when(F.col(feature) <= threshold, walk(2 * k)).otherwise(walk(2 * k + 1))
    return walk(1)


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees from (url, label); label 1 is block."""
    labelled = labelled.select(F.col("url").cast("string").alias("url"), F.col("label").cast("int").alias("label")).filter("label IN (0, 1)")
    # ask a digest bound first, so that the tasks send a few rows each to the one that orders them; it asks for
    # twice the bound, twenty times the estimate's error
    share = 2.0 * MAX_LABELLED / max(labelled.agg(F.approx_count_distinct(F.struct("url", "label"))).first()[0], 1)
    sample = labelled.withColumn("o", F.md5(F.coalesce("url", F.lit("")).cast("binary")))
    if share < 1:
        sample = sample.filter(F.col("o") < F.lit(format(int(share * (1 << 32)), "08x")))
    sample = sample.groupBy("o", "url", "label").agg(F.count("*").alias("weight")).orderBy("o", F.col("url").asc_nulls_first(), "label").limit(MAX_LABELLED)
    base = staged(lexical(sample).select("suffix", *FEATURES[:-1], F.col("row.label").alias("label"), F.col("row.weight").alias("weight")), "url-sample")
    marked = F.sum(F.col("label") * F.col("weight"))
    n, ones = base.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(marked, F.lit(0))).first()
    rate = (ones + 0.5) / (n + 1) if n else 0.0
    prior = int(1000 * ones / n) if n else 0
    suffixes = staged(base.groupBy("suffix").agg(
        F.floor((marked * 1000 + prior * PRIOR) / (F.sum("weight") + PRIOR)).cast("int").alias("suffix_permille")), "url-suffixes")
    if not n or ones in (0, n):
        return Trees(1.0 if n and ones == n else -1.0, [], suffixes, prior)
    model = Trees(math.log(rate / (1 - rate)), [], suffixes, prior)
    # rows with the same features and label differ in nothing that the trees see
    data = staged(model.with_suffix(base).groupBy(*FEATURES, "label").agg(F.sum("weight").alias("weight")).coalesce(2), "url-features")
    levels = [i / BINS for i in range(1, BINS)]
    cuts = data.agg(*[F.percentile(f, F.array(*map(F.lit, levels)), F.col("weight")).alias(f) for f in FEATURES]).first()
    thresholds = {f: sorted({math.floor(x) for x in cuts[f]}) for f in FEATURES}  # BINS - 1 numbers a feature
    bins = F.array(*[F.struct(F.lit(f).alias("feature"), _bin(F.col(f), thresholds[f]).alias("bin")) for f in FEATURES])
    for _ in range(trees):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-model.margin()))
        rows = data.select(*FEATURES, "weight", (F.floor((F.col("label") - p) * SCALE)).cast("long").alias("g"),
                           F.floor(p * (1 - p) * SCALE).cast("long").alias("h"), bins.alias("bins"))
        tree: dict = {"splits": {}, "values": {}}
        for level in range(depth + 1):
            node = _node(tree)
            if level == depth:
                sums = rows.groupBy(node.alias("node")).agg(F.sum(F.col("g") * F.col("weight")).alias("g"), F.sum(F.col("h") * F.col("weight")).alias("h"))
                for r in sums.collect():
                    tree["values"][r["node"]] = RATE * r["g"] / (r["h"] + MIN_WEIGHT * SCALE)
                break
            for r in best_splits(rows.withColumn("node", node).filter(F.col("node") >= 1 << level)).collect():
                tree["splits"][r["node"]] = (r["feature"], thresholds[r["feature"]][r["bin"]])
        model.trees.append(tree)
    return model


def _bin(value: Column, thresholds: list[int]) -> Column:
    """How many thresholds lie below the value."""
    return sum(((value > t).cast("int") for t in thresholds), F.lit(0))


def best_splits(rows: DataFrame) -> DataFrame:
    """(node, feature, bin) with the largest gain of each node that has one."""
    cells = (rows.select("node", "weight", "g", "h", F.inline("bins"))
             .groupBy("node", "feature", "bin").agg(F.sum(F.col("g") * F.col("weight")).alias("g"), F.sum(F.col("h") * F.col("weight")).alias("h")))
    all_ = Window.partitionBy("node", "feature")
    left = all_.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    s = cells.select("node", "feature", "bin", F.sum("g").over(left).alias("gl"), F.sum("h").over(left).alias("hl"),
                     F.sum("g").over(all_).alias("gt"), F.sum("h").over(all_).alias("ht"))
    term = lambda g, h: g.cast("double") * g / (h + MIN_WEIGHT * SCALE)
    gl, hl, gt, ht = (F.col(c) for c in ("gl", "hl", "gt", "ht"))
    gain = term(gl, hl) + term(gt - gl, ht - hl) - term(gt, ht)
    s = s.filter((hl >= MIN_WEIGHT * SCALE) & (ht - hl >= MIN_WEIGHT * SCALE)).withColumn("gain", gain).filter("gain > 0")
    return (s.groupBy("node").agg(F.max_by(F.struct("feature", "bin"), F.struct("gain", "feature", -F.col("bin"))).alias("b"))
            .select("node", "b.feature", "b.bin"))


def judged(urls: DataFrame, model: Trees, rules=RULES, url: str = "url") -> DataFrame:
    """``row``, host, path, rule and verdict of every url."""
    df = model.with_suffix(lexical(urls, url)).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("r.verdict", F.when(model.margin() >= 0, F.lit("block")).otherwise(F.lit("allow")))
    return df.select("row", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))


def held_out(labelled: DataFrame) -> DataFrame:
    """(label, verdict, urls): verdicts of the trees alone on a fifth of the distinct urls, fitted on the others."""
    labelled = labelled.select("url", "label").filter("label IN (0, 1)")
    out = F.crc32(F.coalesce(F.col("url").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    model = train(labelled.filter(~out))
    return (judged(labelled.filter(out).distinct(), model, rules=())
            .groupBy(F.col("row.label").alias("label"), "verdict").agg(F.count("*").alias("urls")))


def url_report(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Every page's host, path, rule and verdict; the trees learn from ``labelled`` (url, label), else from seed labels."""
    pages = pages.select("page_id", "url")
    model = train(seed_labels(pages) if labelled is None else labelled)
    return judged(pages, model).select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


def keep_allowed(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The rows whose url is allowed; same columns."""
    model = train(seed_labels(pages) if labelled is None else labelled)
    # a generator, not a filter, which would compute the features again for each use
    return judged(pages, model).select(F.inline(F.when(F.col("verdict") == "allow", F.array("row"))))
