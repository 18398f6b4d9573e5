"""Rules as data (J6, J7, R6): conditions normalised to intervals, evaluated by a join.

The rule table may come from users and be of any length, so nothing of it is
collected or compiled into an expression.  A condition's atoms become
intervals, one for each field it names (atoms on one field are intersected);
a rule holds for a group if every one of its fields lies in its interval.  A
``default`` rule has no field and always holds; a text outside the grammar
(``field op number`` joined by ``&&``) or an empty interval never does.  The
grammar and the output are those of ``rules.evaluate_rules``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlens.operators.numbering import positions
from defectlens.operators.rollups import keys
from defectlens.operators.rule_table import DEFAULT_ICON, PRIORITY_ICONS

_ATOM = r"^\s*([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)\s*(===|==|>=|<=|>|<)\s*(\d+(?:\.\d+)?)\s*$"
_INF = float("inf")


def numbered_rules(rules: DataFrame, first: int = 0) -> DataFrame:
    """Rules without an id, numbered by metric, condition, text and priority."""
    placed = positions(rules, ["metric", "condition", "text", "priority"], column="rule_id")
    return placed.withColumn("rule_id", (F.col("rule_id") + first).cast("int"))


def rule_clauses(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules with ``n_clauses``, clauses): a clause is (rule_id, field, low, high).

    ``low`` is (value, open) and ``high`` (value, closed) as numbers, so that
    the larger low and the smaller high intersect two intervals.
    """
    text = F.trim(F.coalesce("condition", F.lit("")))
    atoms = rules.withColumn("_default", text == "default").withColumn("_atoms", F.split(text, "&&"))
    good = F.col("_default") | F.forall("_atoms", lambda a: a.rlike(_ATOM))
    valid = atoms.filter(good)
    part = lambda i: F.regexp_extract("a", _ATOM, i)
    one = (valid.filter(~F.col("_default")).select("rule_id", F.explode("_atoms").alias("a"))
           .select("rule_id", F.replace(part(1), F.lit("."), F.lit("__")).alias("field"), part(2).alias("op"), part(3).cast("double").alias("x")))
    equal, op, x = F.col("op").startswith("=="), F.col("op"), F.col("x")
    low = F.when(op == ">", F.struct(x.alias("v"), F.lit(1).alias("open"))).when(
        equal | (op == ">="), F.struct(x.alias("v"), F.lit(0).alias("open"))).otherwise(F.struct(F.lit(-_INF).alias("v"), F.lit(0).alias("open")))
    high = F.when(op == "<", F.struct(x.alias("v"), F.lit(0).alias("closed"))).when(
        equal | (op == "<="), F.struct(x.alias("v"), F.lit(1).alias("closed"))).otherwise(F.struct(F.lit(_INF).alias("v"), F.lit(1).alias("closed")))
    clauses = one.groupBy("rule_id", "field").agg(F.max(low).alias("low"), F.min(high).alias("high"))
    number = clauses.groupBy("rule_id").agg(F.count(F.lit(1)).alias("_n"))
    counted = valid.join(number, "rule_id", "left").withColumn("n_clauses", F.coalesce("_n", F.lit(0))).drop("_n", "_default", "_atoms")
    return counted, clauses


def inside(value: Column, low: Column, high: Column) -> Column:
    """Whether a value lies in an interval; an empty interval holds none."""
    above = F.when(low["open"] == 1, value > low["v"]).otherwise(value >= low["v"])
    below = F.when(high["closed"] == 1, value <= high["v"]).otherwise(value < high["v"])
    return above & below


def metric_values(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Wide metric rows (one column a field) to (by, metric, field, value), without nulls."""
    fields = [c for c in metrics.columns if c not in {*by, "metric"}]
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields])
    return metrics.select(*by, "metric", F.inline(pairs)).filter(F.col("value").isNotNull())


def evaluate_rule_table(metrics: DataFrame, rules: DataFrame, by=None) -> DataFrame:
    """R6 + J6 + R7 for a table of rules (rule_id, metric, condition, text, priority).

    Metric values meet the clauses of their metric and field; a group's rule
    holds if as many clauses match as it has.  Rows of one (group, metric) are
    taken to be one row, as ``rules.metric_fields`` makes them.
    """
    by = keys(by)
    counted, clauses = rule_clauses(rules)
    clauses = clauses.join(counted.select("rule_id", "metric"), "rule_id")
    values = metric_values(metrics, by)
    met = (values.join(clauses, ["metric", "field"]).filter(inside(F.col("value"), F.col("low"), F.col("high")))
           .groupBy(*by, "metric", "rule_id").agg(F.count(F.lit(1)).alias("_met")))
    held = met.join(counted.drop("metric"), "rule_id").filter(F.col("_met") == F.col("n_clauses"))
    always = metrics.select(*by, "metric").join(counted.filter("n_clauses = 0"), "metric")
    columns = [*by, "metric", "rule_id", "text", "priority"]
    out = held.select(*columns).unionByName(always.select(*columns))
    icon = reduce(lambda e, p: F.when(F.lower("priority") == p[0], p[1]).otherwise(e), reversed(list(PRIORITY_ICONS.items())), F.lit(DEFAULT_ICON))
    bold = F.when(F.col("text").contains(":"), F.split_part(F.col("text"), F.lit(":"), F.lit(1))).otherwise(F.lit(""))
    return out.select(*by, "metric", "rule_id", "text", F.coalesce("priority", F.lit("media")).alias("priority"),
                      icon.alias("icon"), bold.alias("emphasis"))
