"""Fill-in-middle: the rank index is exact, cuts and forms equal a plain version."""

import hashlib
import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from defectlens.llm import op12_middle as X


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_hand(doc_id, text):
    t = text or ""
    n = len(t)
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(t), sha(t)
    p, m, s = t[:a], t[a:b], t[b:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, a, b - a, sha(out), sha(t)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "é", "数", "😀", "abc" * 50, "数" * 70, "é" * 33]), max_size=40), st.integers(1, 100))
def test_rank_index_is_exact(parts, error):
    text = "".join(parts)
    offsets = X.boundaries(np.frombuffer(text.encode(), np.uint8))
    index = X.RankIndex(offsets, error)
    assert [index.offset(i) for i in range(len(text) + 1)] == [len(text[:i].encode()) for i in range(len(text) + 1)]
    assert np.abs(index.residual).max() <= error + 1


def test_segments_follow_the_text():
    plain = X.RankIndex(np.arange(1_000_001))
    assert len(plain.first) == 1
    mixed = ("a" * 5000 + "数" * 5000) * 20
    index = X.RankIndex(X.boundaries(np.frombuffer(mixed.encode(), np.uint8)))
    assert 20 < len(index.first) <= 60
    assert [index.offset(i) for i in (0, 7001, 123_456, 200_000)] == [len(mixed[:i].encode()) for i in (0, 7001, 123_456, 200_000)]


@pytest.mark.parametrize("error", [0, 101])
def test_error_must_leave_residuals_in_a_byte(error):
    with pytest.raises(ValueError):
        X.RankIndex(np.arange(3), error)


def test_report_equals_plain_version(spark, make_docs):
    texts = [None, "", "x", "é", "a<P>b", "<S>", "x<M", "<<P", "P>S>M>", "<P", "😀 数字 text " * 30, "é\0\n" * 9, "é" * 40]
    rows = [(i, texts[i % len(texts)]) for i in range(600)] + [(5, "again"), (5, "again"), (None, "no id"), (-3, "minus")]
    rows += [(i, "<" * (i % 9) + "S><M>"[: i % 4] + "word " * (i % 50)) for i in range(600, 900)]
    got = X.middle_report(make_docs(rows))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == sorted((by_hand(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_output_is_the_text(make_docs):
    got = X.fill_in_middle(make_docs([(i, "näh und fern " * 5) for i in range(40)])).collect()
    for r in got:
        if r.form == "psm":
            a, b = r.prefix_chars, r.prefix_chars + r.middle_chars
            t = "näh und fern " * 5
            assert r.output == f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}" and r.segments == 1


def test_empty_table_and_very_long_text(make_docs):
    assert X.middle_report(make_docs([])).collect() == []
    rows = [(i, "ä数 word " * 700_000) for i in range(3)]
    t = time.time()
    got = X.middle_report(make_docs(rows)).collect()
    assert sorted(map(tuple, got)) == sorted(by_hand(*r) for r in rows)
    assert time.time() - t < 60
