"""Edge cases of the JS numeric and string semantics."""

from pyspark.sql import functions as F

from defectlens.functions import (canonical_priority, clamp, first_truthy, first_truthy_str, fixed1, fixed2,
                                  initials, js_round, label_or, normalize_header, pct, split_tags, sprint_number,
                                  strip_accents, truthy_or)


def one(spark, expr, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_js_round_ties_to_plus_infinity(spark):
    got = one(spark, js_round("x"), "x double", [(-2.5,), (2.5,), (16.5,), (-0.4,), (0.5,)])
    assert got == [-2, 3, 17, 0, 1]


def test_fixed2_matches_to_fixed(spark):
    # toFixed rounds the exact binary value: 1.005 = 1.00499..., 0.285 = 0.28499...,
    # 8.345 = 8.34500...06, 2.675 = 2.67499... (its product 267.5 is a rounded tie),
    # 0.125 is an exact tie (toFixed takes the larger n).
    got = one(spark, fixed2("x"), "x double", [(1.005,), (0.285,), (8.345,), (2.675,), (1.5,), (-1.005,), (0.125,)])
    assert got == [1.0, 0.28, 8.35, 2.67, 1.5, -1.0, 0.13]
    # the naive floor(x*100+.5) gets 1.005 right but 2.675 wrong; ours must not
    naive = one(spark, F.floor(F.col("x") * 100 + 0.5) / 100, "x double", [(2.675,)])
    assert naive == [2.68]


def test_fixed1(spark):
    assert one(spark, fixed1("x"), "x double", [(1.25,), (58.58,), (-0.05,)]) == [1.3, 58.6, 0.0]


def test_pct_guards_zero(spark):
    got = one(spark, pct(F.col("a"), F.col("b")), "a long, b long", [(1, 0), (165, 1000), (1, 3)])
    assert got == [0, 17, 33]


def test_truthy_chains(spark):
    rows = [(0, 5), (None, None), (3, 7)]
    assert one(spark, first_truthy("a", "b"), "a long, b long", rows) == [5, 0, 3]
    assert one(spark, truthy_or(F.col("a"), F.lit(9)), "a long, b long", rows) == [9, 9, 3]
    srows = [("", "x"), (None, None), ("a", "b")]
    assert one(spark, first_truthy_str("a", "b", default="d"), "a string, b string", srows) == ["x", "d", "a"]


def test_clamp(spark):
    assert one(spark, clamp(F.col("x"), F.lit(0), F.lit(100)), "x double", [(-5.0,), (50.0,), (150.0,)]) == \
        [0.0, 50.0, 100.0]


def test_priority_canonicalization(spark):
    rows = [("Más alta",), ("mas alta",), ("Alta",), ("Media",), ("Baja",), ("Más baja",), ("Major",),
            ("Trivial",), ("",), (None,)]
    got = one(spark, canonical_priority("p"), "p string", rows)
    assert got == ["Major", "Major", "High", "Medium", "Low", "Trivial", "Major", "Trivial", "Other", "Other"]
    assert one(spark, strip_accents("p"), "p string", [("Más Categoría Ñ",)]) == ["mas categoria n"]


def test_tags(spark):
    got = one(spark, split_tags("t"), "t string", [("a; B|c,,",), ("",), (None,)])
    assert got == [["a", "b", "c"], [], []]
    two = one(spark, split_tags("t", "u"), "t string, u string", [("a,b", "C| d")])
    assert two == [["a", "b", "c", "d"]]


def test_sprint_labels(spark):
    got = one(spark, sprint_number(F.col("s")), "s string", [("Sprint 5",), ("Sprint 105",), ("Sprint",), (None,)])
    assert got == [5, 105, None, None]


def test_labels_and_initials(spark):
    assert one(spark, label_or("m", "Sin módulo"), "m string", [("  ",), (None,), (" POS ",)]) == \
        ["Sin módulo", "Sin módulo", "POS"]
    assert one(spark, initials("n"), "n string", [("Mariana Cárdenas",), ("ana",)]) == ["MC", "a"]


def test_header_normalization():
    assert normalize_header(" Versión ") == "versi_n"
    assert normalize_header("Asignado a") == "asignado_a"
    assert normalize_header("Tipo  Incidencia!") == "tipo_incidencia_"
