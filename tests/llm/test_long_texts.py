"""Very long texts: time in proportion to the text, whole results."""

import random
import time

import pytest
from pyspark.sql import functions as F

from defectlens.llm import op1_secrets as secrets
from defectlens.llm import op4_quality as quality
from tests.llm.test_boilerplate_lines import OTHER, PROSE
from tests.llm.test_text_operators import by_duckdb, by_spark


def seconds(run):
    t = time.time()
    run()
    return time.time() - t


def test_secrets_of_100_000_matches(make_docs):
    rng = random.Random(1)
    word = lambda: "%025x" % rng.getrandbits(100)
    many = " é ".join(word() for _ in range(100_000))
    docs = make_docs([(1, many), (2, "password=abcdefgh " * 50_000)])
    secrets.secret_report(make_docs([(1, "x")])).collect()
    got = {}
    took = seconds(lambda: got.update({r.doc_id: r for r in secrets.secret_report(docs).collect()}))
    assert got[1].n_hex == 100_000 and got[2].n_assign == 50_000
    assert got[1].spans.split(",")[-1] == f"hex:{len(many) - 25}:{len(many)}"
    texts = {}
    took_too = seconds(lambda: texts.update({r.doc_id: r.text for r in secrets.redact(docs).collect()}))
    assert texts[1] == " é ".join(["[REDACTED]"] * 100_000) and texts[2] == "[REDACTED] " * 50_000
    assert took < 25 and took_too < 25  # with the fit; quadratic work took minutes


def test_runs_apart_from_base_spans(spark):
    """The sweep equals asking every pair."""
    rng = random.Random(3)
    rows = []
    for k in range(300):
        at, runs = 0, []
        for _ in range(rng.randrange(6)):
            at += rng.randrange(1, 5)
            runs.append((at, 3, at + rng.randrange(1, 6), "r", 0, 0))
            at = runs[-1][2]
        base = [(s, rng.randrange(3), s + rng.randrange(1, 12), "b", 0, 0) for s in (rng.randrange(30) for _ in range(rng.randrange(4)))]
        rows.append((k, runs, sorted(base)))
    df = spark.createDataFrame(rows, f"id int, runs {secrets._SPAN}, base {secrets._SPAN}")
    got = {r.id: [tuple(x)[:3] for x in r.a] for r in df.select("id", secrets._apart(F.col("runs"), F.col("base")).alias("a")).collect()}
    assert got == {k: [r[:3] for r in runs if not any(b[0] < r[2] and r[0] < b[2] for b in base)] for k, runs, base in rows}


def test_chunks_do_not_change_spans(make_docs, monkeypatch):
    text = " ".join(f"token={'x' * (k % 12)} {'%024x' % k}" for k in range(500))
    docs = make_docs([(1, text), (2, ""), (3, None)])
    whole = docs.select("doc_id", secrets.base_spans(F.coalesce("text", F.lit(""))).alias("b")).collect()
    monkeypatch.setattr(secrets, "CHUNK", 3)
    assert docs.select("doc_id", secrets.base_spans(F.coalesce("text", F.lit(""))).alias("b")).collect() == whole
    spans = next(r.b for r in whole if r.doc_id == 1)
    assert all(text[x.s:x.e] == x.v and text.encode()[x.bs:x.be].decode() == x.v for x in spans) and len(spans) > 500


@pytest.mark.parametrize("ids", [[None] * 6000, list(range(6000)), [7] * 3000 + list(range(3000))])
def test_ordinary_samples_whatever_the_ids(make_docs, ids):
    """Repeated and null ids neither empty the sample nor fill it."""
    docs = make_docs([(i, f"ordinary{k % 50}words here{k}") for k, i in enumerate(ids)])
    samples = secrets.labelled_samples(docs, secrets.scan(docs)).filter("label = 0")
    assert samples.count() >= 1
    small = docs.limit(40)
    assert by_spark(secrets.secret_report(small)) == by_duckdb(secrets.ORACLE, documents=small.select("doc_id", "text"))


@pytest.mark.parametrize("line", ["click here " + "a" * 5_000_000, "log in " * 100_000, "released under the " * 100_000, "é" * 2_500_000, " | " * 500_000])
def test_quality_of_a_line_of_megabytes(make_docs, line):
    docs = make_docs([(1, f"{PROSE}\n{line}\n{OTHER}")])
    quality.quality_report(make_docs([(1, "x")])).collect()
    assert seconds(lambda: quality.quality_report(docs).collect()) < 12
    assert seconds(lambda: quality.keep_clean(docs).collect()) < 24


LINES = ["log in", "Log in, sign up", "log in sign up log in", "catalog in", "log information", "xlog in", "élog iné", "click here now " + PROSE,
         PROSE + " sign up", "privacy policy terms of use cookie policy " * 8, "privacy policy and terms of use cookie policy for you " * 4,
         "released under the MIT license", "The album was released under the label", "released under the label by admit", "released under the ümit label",
         "GPL: " + PROSE + " released under the", "Licensed under this work is licensed under", "this work is licensed under the terms of use",
         "all rights reserved" * 3, "all rights reserved " * 30, "sign up " + "word " * 18, "sign up " + "word " * 17, "a" * 300 + " log in", "LOG IN\r"]


def test_boilerplate_equal_sql(make_docs):
    docs = make_docs([(k, f"{PROSE}\n{line}\n{OTHER}") for k, line in enumerate(LINES)] + [(100 + k, line) for k, line in enumerate(LINES)])
    got = quality.quality_report(docs)
    assert by_spark(got) == by_duckdb(quality.ORACLE, documents=docs.select("doc_id", "text"))
    lost = {r.doc_id: r.lost_chars > 0 for r in got.collect()}
    assert lost[0] and lost[2] and not lost[3] and not lost[4] and not lost[7] and lost[9] and lost[11] and not lost[12]
