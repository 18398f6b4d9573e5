"""Rule compiler (R6): grammar, rejection, unknown fields, default, override."""

import pytest
from pyspark.sql import functions as F

from defectlens.operators import rules as RU
from defectlens.operators.rule_table import DEFAULT_RULES


def test_parse():
    assert RU.parse_condition("default") is None
    assert RU.parse_condition("avg >= 150 && avg < 200") == [("avg", ">=", 150.0), ("avg", "<", 200.0)]
    assert RU.parse_condition("pending === 0") == [("pending", "==", 0.0)]
    assert RU.parse_condition("byPriority.critical > 5") == [("byPriority.critical", ">", 5.0)]
    for bad in ["process.exit(1)", "avg > 1 || avg < 0", "avg >", "'x' == 'x'", "avg > 1 &&", "require('fs')"]:
        with pytest.raises(RU.RuleError):
            RU.parse_condition(bad)


def _eval(spark, text, row, schema):
    df = spark.createDataFrame([row], schema)
    return df.select(RU.compile_condition(text, set(df.columns)).alias("ok")).collect()[0].ok


def test_compile(spark):
    sch = "avg double, byPriority__critical double"
    assert _eval(spark, "avg >= 150 && avg < 200", (160.0, 1.0), sch) is True
    assert _eval(spark, "avg >= 150 && avg < 200", (200.0, 1.0), sch) is False
    assert _eval(spark, "byPriority.critical > 5", (1.0, 6.0), sch) is True
    assert _eval(spark, "unknown > 1", (1.0, 6.0), sch) is False          # unknown field -> false
    assert _eval(spark, "default", (1.0, 6.0), sch) is True
    assert _eval(spark, "Math.max(1) > 0", (1.0, 6.0), sch) is False      # rejected -> false
    assert _eval(spark, "avg > 1", (None, 6.0), sch) is False             # null -> false


def test_evaluate_rules_and_override(spark):
    metrics = spark.createDataFrame(
        [("g", "testCases", 160.0, None, None, None, None, None)],
        "grp string, metric string, avg double, efficiency double, total double, pending double, "
        "byPriority__critical double, critical double")
    out = RU.evaluate_rules(metrics, DEFAULT_RULES, ["grp"]).orderBy("rule_id").collect()
    texts = [r.text for r in out]
    assert texts[0].startswith("Acceptable coverage") and len(out) == 4      # tier + 3 defaults
    assert out[0].emphasis == "Acceptable coverage" and out[0].icon == "⚠️"
    defaults = RU.rules_frame(spark)
    user = spark.createDataFrame([(100, "mediaCasosEjecutados", "default", "Custom", "alta")],
                                 "rule_id int, metric string, condition string, text string, priority string")
    eff = RU.effective_rules(defaults, user)
    tc = eff.filter(F.col("metric") == "testCases").collect()
    assert [r.text for r in tc] == ["Custom"]
    assert eff.filter(F.col("metric") == "cycleTime").count() == 5
