"""Attention-based classifier: gradients, features, held-out accuracy, odd labels."""

import numpy as np
import pytest

from defectlens.llm import op13_attention as A
from tests.conftest import SF_ORACLE

LABELS = "doc_id long, quality int, label double, _key string"


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    x, first = rng.normal(size=(9, 5)), np.array([0, 1, 4, 9])
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    p = {"W": rng.normal(size=(5, 4)), "b": rng.normal(size=4), "V": rng.normal(size=(4, 3)), "U": rng.normal(size=(4, 3)),
         "w": rng.normal(size=3), "c": rng.normal(size=4), "d": np.array(0.3)}

    def loss(q):
        s = A._forward(q, x, first)["score"]
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / weight.sum()

    grads = A._gradients(p, x, first, y, weight)
    for k, v in p.items():
        for i in np.ndindex(v.shape):
            up, down = ({**p, k: v.copy()} for _ in range(2))
            up[k][i] += 1e-6
            down[k][i] -= 1e-6
            assert np.asarray(grads[k])[i] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-6)


def test_attention_finds_the_passage():
    """Bags whose label comes from one of their rows: the weight goes there."""
    rng = np.random.default_rng(2)
    rows, first, y, where = [], [0], [], []
    for i in range(600):
        n = int(rng.integers(1, 9))
        bag = rng.normal(size=(n, 6))
        y.append(i % 2)
        where.append(first[-1] + int(rng.integers(n)))
        if i % 2 == 0:
            bag[where[-1] - first[-1], 0] = 6
        rows.append(bag)
        first.append(first[-1] + n)
    x, first = np.concatenate(rows), np.array(first)
    model = A.fit(x, first, np.array(y))
    assert ((model.score(x, first) >= 0.5) == np.array(y)).mean() > 0.97
    a = model.attention(x, first)
    assert np.add.reduceat(a, first[:-1]) == pytest.approx(1)
    marked = [a[k] * np.diff(first)[i] for i, k in enumerate(where) if i % 2 == 0 and np.diff(first)[i] > 3]
    assert np.median(marked) > 2


def test_features_do_not_depend_on_pieces(monkeypatch):
    text = ("One two, three!! four. Ünf sechs\n" * 400 + "x" * 3000 + " end " + "| a b " * 500).encode()
    data = np.frombuffer(text, np.uint8)
    whole = A.passage_features(data)
    monkeypatch.setattr(A, "PIECE_BYTES", 1000)
    assert np.array_equal(A.passage_features(data), whole)
    assert len(whole) == -(-len(text.split()) // A.PASSAGE_WORDS)
    assert len(A.passage_features(data, 5)) == 5


def test_texts_without_words_are_one_passage():
    for t in (b"", b" \n\t "):
        assert A.passage_features(np.frombuffer(t, np.uint8)).shape == (1, A.N_FEATURES)
    assert len(A.passage_features(np.frombuffer(b"  one", np.uint8))) == 1


def test_held_out_accuracy_and_whole_result(spark):
    docs, labels = (spark.read.parquet(f"{SF_ORACLE}/{t}.parquet") for t in ("documents", "labels"))
    got = A.quality_report(docs, labels).toPandas()
    assert len(got) == docs.count() and got.doc_id.is_unique
    x = got.merge(labels.toPandas(), on="doc_id")
    out = x[x.held_out]
    assert len(out) > 50 and (out.predicted == out.quality).mean() > 0.95
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    assert A.quality_report(docs, labels).toPandas().sort_values("doc_id").score.tolist() == got.sort_values("doc_id").score.tolist()


def test_held_out_labels_are_never_learned(spark):
    """Turned labels of held-out rows change no score."""
    from pyspark.sql import functions as F
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(A.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (A.quality_report(docs, x).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(1, 1), (3, 1), (None, 0), (4, None)], 0.75), ([(1, 0), (1, 1), (1, 1)], 2 / 3)])
def test_without_two_classes_the_share_is_the_score(spark, make_docs, labels, score):
    known = spark.createDataFrame([(*x, 1.0, "k") for x in labels], LABELS)
    got = A.quality_report(make_docs([(1, "a b"), (3, "c"), (4, None), (None, "d"), (3, "c")]), known).collect()
    assert len(got) == 5 and all(r.score == pytest.approx(score) for r in got)


def test_nulls_repeats_empty_table_and_long_text(spark, make_docs):
    known = spark.createDataFrame([(i, i % 2, 1.0, "k") for i in range(1, 60)], LABELS)
    rows = [(i, "Good words in a line. " * 20 if i % 2 else "$$$ ### " * 40) for i in range(1, 60)] + [(3, "Good words in a line. " * 20)]
    rows += [(None, None), (100, ""), (101, None), (102, "Good words in a line. " * 200_000), (103, "z" * 3_000_000)]
    got = {}
    for r in A.quality_report(make_docs(rows), known).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[3]) == 2 and got[3][0] == got[3][1] and got[3][0].predicted == 1 and got[4][0].predicted == 0
    assert got[102][0].predicted == 1 and got[102][0].passages == -(-5 * 200_000 // A.PASSAGE_WORDS)
    assert got[100][0].score == got[101][0].score == got[None][0].score and not got[None][0].held_out
    assert got[103][0].passages == 1
    assert A.quality_report(make_docs([]), known).collect() == []
