"""Merkle manifest against a plain tree built in Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from defectlens.llm import op11_merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, h string, node int, path string, rank int, block int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row):
    return H(*map(field, row))


def tree(leaves):
    """Levels from the leaves to the one root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        top = levels[-1]
        levels.append([H(*top[i:i + 2]) for i in range(0, len(top), 2)])
    return levels


def way(levels, i):
    """(sibling, sibling is on the left) or None of each level."""
    for level in levels[:-1]:
        j = i ^ 1
        yield (level[j], j < i) if j < len(level) else None
        i //= 2


def by_hand(rows):
    none_first = lambda v: (v is not None, v if v is not None else 0)
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (none_first(r[0]), leaf(r))) for x in langs}
    trees = {x: tree([leaf(r) for r in g]) for x, g in groups.items()}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(groups[x]):
            path = [*way(trees[x], i), *way(top, k)]
            tampered = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf((r[0], r[1], r[2], r[3] + 1, r[4])) if tampered else leaf(r)
            for s in path:
                h = H(h) if s is None else H(s[0], h) if s[1] else H(h, s[0])
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], H(*[s[0] for s in path if s]), h, h == top[-1][0]))
    return sorted(out, key=str)


def report(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], SCHEMA).repartition(5)
    got = M.merkle_report(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=str)


def test_nulls_ties_repeats_and_lone_leaves(spark):
    rows = [(i, f"s{i % 3}", x, i * 11, f"té {i}") for x, n in (("de", 5), ("en", 8), (None, 3), ("", 1)) for i in range(n)]
    rows += [(3, "s", "de", 1, "other"), (3, "s", "de", 1, "other"), (None, None, None, None, None), (None, None, "en", None, ""),
             (40, "a", "én", None, None)]
    assert report(spark, rows) == by_hand(rows)


@pytest.mark.parametrize("bits", [2, 8])
def test_several_tiers(spark, bits, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_BITS", bits)
    rng = random.Random(bits)
    rows = [(rng.randrange(10_000), "s", x, rng.choice([None, 5]), "t" * rng.randrange(30)) for x, n in (("en", 530), ("fr", 65), ("es", 1)) for _ in range(n)]
    got = report(spark, rows)
    assert got == by_hand(rows)
    assert {r[-1] for r in got} == {True, False}


def test_one_row_and_no_row(spark):
    assert report(spark, [(7, "s", "en", 1, "x")]) == by_hand([(7, "s", "en", 1, "x")])
    assert report(spark, []) == []


def test_very_long_text(spark):
    rows = [(1, "s", "en", 1, "é" * 3_000_000), (2, "s", "en", 2, "")]
    assert report(spark, rows) == by_hand(rows)


def test_one_exchange_and_sort_a_tier(spark):
    """The digit columns go away in place: no exchange or sort between the steps."""
    rows = spark.range(5000).selectExpr("cast(id % 3 as string) AS lang", "11 + cast(id div 100000 as int) AS height", "id div 3 AS rank",
                                        "sha2(string(id), 256) AS h", "id AS doc_id")
    plan = M._blocks(rows, ["lang"], 0, ["doc_id"], M.BLOCK_BITS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1
    assert "Join" not in plan


def test_fold_of_a_wrong_leaf_is_another_root(spark):
    rows = [(i, "s", "en", i, str(i)) for i in range(20)]
    df = spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], SCHEMA)
    leaves = df.select("lang", "doc_id", M.leaf_digest([F.col(c) for c in M.FIELDS]).alias("h"))
    proofs = M.merkle_proofs(leaves, "lang", ["doc_id"], ["doc_id"])
    got = proofs.select((M.fold(F.col("h"), F.col("path")) == F.col("root")).alias("ok"),
                        (M.fold(F.sha2("h", 256), F.col("path")) == F.col("root")).alias("bad")).collect()
    assert len(got) == 20 and all(r.ok and not r.bad for r in got)
