"""Similarity join, decontamination, WARC, suffix dedup, components and the pipeline against brute force."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from defectlens.llm import op3_jaccard as jaccard
from defectlens.llm import op7_decontamination as leaks
from defectlens.llm import op8_warc as warc
from defectlens.llm import op9_suffixes as suffixes
from defectlens.llm.components import components


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def plain_join(rows):
    """{row: (class id, links, equal)} by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[0-9a-zA-Z\u0080-\U0010ffff]+", (text or "").lower())
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    n = len(rows)
    near = lambda a, b: bool(a) and bool(b) and 5 * len(a & b) >= 4 * len(a | b)
    links = [[j for j in range(n) if j != i and near(sets[i], sets[j])] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in links[i]:
                root[i] = root[j] = min(root[i], root[j])
    names = {}
    for i in range(n):
        ids = [rows[k][0] for k in range(n) if root[k] == root[i] and rows[k][0] is not None]
        names[i] = min(ids) if ids and sets[i] else rows[i][0]
    return sorted((str(rows[i][0]), str(names[i]), len(links[i]), 1 + sum(sets[j] == sets[i] for j in range(n) if j != i and sets[i])) for i in range(n))


def near_copies(rng):
    rows = [(k, " ".join(words(rng, 60 + k % 50))) for k in range(40)]
    for k in range(40, 100):
        w = rng.choice(rows[:10])[1].split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((k, " ".join(w)))
    short = [(100, "One two"), (101, "one, TWO!"), (102, "one two three"), (103, None), (104, ""), (105, "?!"), (106, "É è"), (107, "é È")]
    return rows + short + [(5, rows[5][1]), (None, rows[7][1]), (None, "alone here"), (9, "other text of a repeated id")]


@pytest.mark.parametrize("block", [4, 256])
def test_join_equals_all_pairs(make_docs, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies(random.Random(1))
    got = jaccard.join(make_docs(rows)).collect()
    assert sorted((str(r["key"]), str(r["class_id"]), r["n_links"], r["n_equal"]) for r in got) == plain_join(rows)


def test_keep_one_of_each_group(make_docs):
    rows = [r for r in near_copies(random.Random(2)) if r[0] not in (None, 9, 5)]
    docs = make_docs(rows)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(int(a) for a, b, _, _ in plain_join(rows) if a == b)
    again = make_docs([(1, rows[0][1]), (1, rows[0][1]), (None, rows[0][1]), (None, rows[1][1])])  # ids that name no row
    assert jaccard.keep_one(again).count() == 2
    assert jaccard.join(make_docs([])).count() == 0


def test_chain_sends_rows_by_bucket_pairs(make_docs, monkeypatch):
    """Texts that slide along one word list: neighbours at 0.76, one long component, no link."""
    seen, places = [], jaccard._places

    def spied(members, buckets):
        seen.append((buckets, members, places(members, buckets)))
        return seen[-1][-1]

    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "_places", spied)
    sent = []
    for n in (200, 800):
        rows = [(k, " ".join(f"w{k * 3 + m}" for m in range(26))) for k in range(n)]
        assert {(r["class_id"] == r["key"], r["n_links"]) for r in jaccard.join(make_docs(rows)).collect()} == {(True, 0)}
        buckets, members, dealt = seen[-1]
        ids = {}
        for r in buckets.collect():
            ids.setdefault(r["bucket"], []).append(r["id"])
        pairs = {(a, b) for group in ids.values() for a in group for b in group if a < b}
        got = dealt.collect()
        in_large = {r["id"] for r in members.filter("size > 16").collect()}
        assert len(got) == len(set(got)) and len(in_large) > n / 2
        assert sum(r["id"] in in_large for r in got) <= 2 * len(pairs)
        sent.append(len(got))
    assert sent[1] <= 5 * sent[0]


def test_large_group_counts_each_pair_once(make_docs, monkeypatch):
    """Near copies of one text over many blocks: every link once, though most pairs share many buckets."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(5)
    base = words(rng, 120)
    rows = []
    for k in range(60):
        w = list(base)
        w[rng.randrange(120)] = f"x{k % 40}"
        rows.append((k, " ".join(w)))
    got = jaccard.join(make_docs(rows)).collect()
    assert sorted((str(r["key"]), str(r["class_id"]), r["n_links"], r["n_equal"]) for r in got) == plain_join(rows)


def test_posterior_bound():
    least = jaccard.least_agreements()
    assert least[8] <= 1 and 50 <= least[96] <= 65 and list(least) == sorted(least)


def plain_leaks(rows, items, window):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for i, text in rows:
        w, hit, names = split(text), set(), set()
        for name, t in items:
            q = split(t)
            n = min(window, len(q))
            for a in range(len(q) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b:b + n] == q[a:a + n]:
                        hit |= set(range(b, b + n))
                        names.add(str(name) if name is not None else "")
        out.append((str(i), len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("chars", [40, 2_000_000])
def test_decontamination_equals_plain(spark, make_docs, chars):
    rng = random.Random(3)
    items = [(k, " ".join(words(rng, n))) for k, n in enumerate([30, 12, 10, 9, 2, 1, 0, 25])] + [(10, None), (1, "w1 W2,w3 é"), (None, "w7")]
    rows = [(k, " ".join(words(rng, 80))) for k in range(20)]
    for k in range(20, 40):
        w = words(rng, 40)
        q = rng.choice(items)[1] or ""
        rows.append((k, ". ".join([*w[:20], q.upper() if k % 2 else q, *w[20:]])))
    rows += [(None, None), (3, ""), (3, items[0][1] * 3), (50, "w1 w2 w3 é É"), (51, "x " * 3000 + items[7][1])]
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, spans string")
    got = leaks.contamination(make_docs(rows), bench, ["doc_id"], block_chars=chars).collect()
    assert sorted(tuple([str(r["doc_id"]), *list(r)[1:]]) for r in got) == plain_leaks(rows, items, 10)
    kept = leaks.drop_contaminated(make_docs(rows), bench)
    assert kept.count() == sum(not r[-1] for r in plain_leaks(rows, items, 10)) and kept.columns == make_docs([]).columns
    assert leaks.contamination_report(make_docs([]), bench).count() == 0
    assert not any(r["contaminated"] for r in leaks.contamination_report(make_docs(rows), bench.limit(0)).collect())


def test_warc_round_trip(spark):
    long = "é<p>text</p>\r\n\r\nWARC/1.1\r\n" * 4000
    rows = [(5, "http://a/x", long), (3, "http://b\r\ny", long), (9, None, long), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"),
            (7, "u", "q" * 100), (8, "u", "q" * 100), (None, "u", "q" * 100), (None, "u", "only without an id " * 9), (7, "u", "q" * 100)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.warc_report(pages)
    want = duckdb.connect()
    want.register("pages", pages.toArrow())
    names = sorted(got.columns)
    assert sorted(str([r[c] for c in names]) for r in got.collect()) == sorted(str(list(r)) for r in want.sql(f"SELECT {', '.join(names)} FROM ({warc.ORACLE})").fetchall())
    assert warc.warc_report(pages.limit(0)).count() == 0


def test_warc_damage_is_told(spark, tmp_path):
    body = ("é" * 300).encode()
    records = warc.records_of(1, "u", body, None, None, "k", 200) + warc.records_of(2, "u", b"z" * 900, None, None, "l", 200)
    (tmp_path / "a.warc").write_text("".join(r + warc.END for k, r in enumerate(records) if k != len(records) - 2), newline="")
    got = {r["page_id"]: r for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert got[1]["payload"] == body and got[1]["complete"] and not got[2]["complete"] and got[2]["payload"] is None
    assert warc.unframed(warc.framed(body)) == body and warc.unframed(b"5\r\nabc\r\n0\r\n\r\n") is None and warc.unframed(b"zz") is None


def test_warc_damaged_archives_keep_all_other_records(spark, tmp_path):
    page = lambda k, body=None: warc.records_of(k, "u", body or f"body {k} é".encode(), None, None, f"{k}", 200)
    joined = lambda *records: "".join(r + warc.END for r in records)
    length = lambda r, text: re.sub("Content-Length: [0-9]+", "Content-Length: " + text, r)
    (one,), (two,), (three,), (four,) = (page(k) for k in (1, 2, 3, 4))
    long = page(9, b"z" * 900)
    files = {
        "short": joined(length(one, "5"), two, three), "over": joined(length(one, "100"), two, three),
        "word": joined(length(one, "many"), two, three), "minus": joined(length(one, "-3"), two, three),
        "huge": joined(length(one, "9" * 30), two, three), "none": joined(re.sub("Content-Length.*\r\n", "", one), two, three),
        "header": joined(one.split(warc.END)[0], two, three).replace(warc.END, "\r\n", 1), "noise": "noise\r\n" + joined(two, three),
        "cut": joined(two, three) + four[:-4], "middle": joined(two, length(one, "7"), three)}
    for name, text in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_text(text, newline="")
        got = warc.read_warc(spark, str(tmp_path / name)).collect()
        whole = {r["page_id"]: bytes(r["payload"]) for r in got if r["complete"]}
        assert whole == {k: f"body {k} é".encode() for k in (2, 3)}, name
        assert len(got) == 3 and [r["payload"] for r in got if not r["complete"]] == [None], name
    for name, kept in (("first", long[1:]), ("one", long[:1]), ("twice", [*long, long[1]]), ("number", [long[0].replace("Number: 1", "Number: x"), *long[1:]])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_text(joined(two, *kept), newline="")
        got = warc.read_warc(spark, str(tmp_path / name)).collect()
        assert [r["page_id"] for r in got if r["complete"]] == [2] and len(got) == (3 if name == "number" else 2), name
        assert not any(r["payload"] for r in got if not r["complete"]), name


def plain_suffixes(rows, n, keep):
    raws = [(t or "").encode() for _, t in rows]
    seen: dict = {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0]))
    for k in order:
        for s in range(len(raws[k]) - n + 1):
            seen.setdefault(raws[k][s:s + n], []).append((k, s))
    out = []
    for k, raw in enumerate(raws):
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - n + 1):
            places = seen[raw[s:s + n]]
            if len(places) > 1 and (keep == "none" or places[0] != (k, s)):
                gone[s:s + n] = True
        edges = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
        left = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((str(rows[k][0]), len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def repeated_texts(rng):
    shared = ["".join(rng.choices("abcdé", k=n)) for n in (30, 45, 80, 20)]
    rows = []
    for k in range(60):
        parts = ["".join(rng.choices("abcdefgh", k=rng.randrange(30))) for _ in range(3)]
        rows.append((k, parts[0] + rng.choice(shared) + parts[1] + (shared[1] if k % 3 == 0 else "") + parts[2]))
    rows += [(60, "x" * 200), (61, rows[0][1]), (62, ""), (63, None), (64, "short")]
    return rows


@pytest.mark.parametrize("keep,shard", [("none", 1000), ("none", 2), ("first", 1000), ("first", 2)])
def test_suffix_dedup_equals_plain(make_docs, monkeypatch, keep, shard):
    monkeypatch.setattr(suffixes, "GRAM", 12)
    rows = repeated_texts(random.Random(5))
    got = suffixes.dedup(make_docs(rows), 40, keep, 12, shard).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == plain_suffixes(rows, 40, keep)


def test_suffix_dedup_of_null_and_repeated_ids(make_docs):
    rows = [(None, "k" * 90), (None, "k" * 90), (1, "m" * 30), (1, "z" * 10), (2, "a" * 39)]
    got = suffixes.dedup(make_docs(rows), 40, "none", 12).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == plain_suffixes(rows, 40, "none")
    assert suffixes.suffix_report(make_docs([])).count() == 0


@pytest.mark.parametrize("keep", ["none", "first"])
def test_suffix_dedup_returns_the_rest(make_docs, monkeypatch, keep):
    """The remaining text is the bytes of the digest; a split character is left out."""
    rng = random.Random(8)
    rows = repeated_texts(rng)
    got = suffixes.dedup(make_docs(rows), 40, keep, 12).collect()
    texts = dict(rows)
    for r in got:
        kept = r["text"].encode()
        assert r["n_bytes"] - r["n_removed"] - len(kept) in (0, 1, 2)
        if not r["n_removed"]:
            assert r["text"] == (texts[r["doc_id"]] or "")
        if r["n_bytes"] - r["n_removed"] == len(kept):
            assert hashlib.sha256(kept).hexdigest() == r["kept_sha256"]
    assert any(r["n_removed"] for r in got)


def plain_passages(rows, n):
    words = [(t or "").encode().split() for _, t in rows]
    seen: dict = {}
    for k, w in enumerate(words):
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i:i + n]), set()).add(k)
    out = []
    for k, w in enumerate(words):
        hit = np.zeros(len(w), bool)
        for i in range(len(w) - n + 1):
            if len(seen[tuple(w[i:i + n])]) > 1:
                hit[i:i + n] = True
        out.append((str(rows[k][0]), int(hit.sum())))
    return sorted(out)


def repeated_passages(rng):
    words = ["".join(rng.choices("abcdé", k=rng.randrange(1, 4))) for _ in range(300)]
    shared = [rng.choices(words, k=n) for n in (5, 6, 7, 12, 30)]
    rows = []
    for k in range(60):
        parts = [rng.choices(words, k=rng.randrange(15)) for _ in range(3)]
        text = parts[0] + rng.choice(shared) + parts[1] + rng.choice(shared)[:rng.randrange(3, 9)] + parts[2]
        rows.append((k, rng.choice([" ", "\n", " \t "]).join(text)))
    own = rng.choices(words, k=8)
    rows += [(60, " ".join(["a"] * 40)), (61, rows[0][1]), (61, rows[0][1]), (62, ""), (63, None), (64, "one two"),
             (65, " ".join(own + ["x"] + own)), (None, " ".join(shared[3])), (None, " ".join(shared[3])), (66, "z" * 90 + " y")]
    return rows


@pytest.mark.parametrize("keep,shard,part,length", [("none", 1000, 1 << 22, 40), ("none", 2, 64, 40), ("none", 2, 1 << 22, 400),
                                                    ("first", 1000, 1 << 22, 40)])
def test_passages_of_words_equal_plain(make_docs, monkeypatch, keep, shard, part, length):
    """Passages shorter than the removed strings are counted where another row has them, not within one text."""
    monkeypatch.setattr(suffixes, "GRAM", 12)
    monkeypatch.setattr(suffixes, "PART", part)
    rows = repeated_passages(random.Random(4))
    got = suffixes.dedup(make_docs(rows), length, keep, 12, shard, 6).collect()
    assert sorted((str(r["doc_id"]), r["n_passage_words"]) for r in got) == plain_passages(rows, 6)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == plain_suffixes(rows, length, keep)
    assert any(r["n_passage_words"] and not r["n_removed"] for r in got)


def test_passage_below_the_removed_length(make_docs):
    """51 words of fewer than 400 bytes in two texts; repeated within one text only; 50 words."""
    words = [f"{k}w" for k in range(400)]
    rows = [(1, " ".join(words[:80])), (2, "x " + " ".join(words[10:61]) + " y"), (3, " ".join(words[100:160] + ["q"] + words[100:160])),
            (4, " ".join(words[200:250])), (5, "p " + " ".join(words[200:250]))]
    got = {r["doc_id"]: (r["n_removed"], r["n_passage_words"]) for r in suffixes.suffix_report(make_docs(rows)).collect()}
    assert got == {1: (0, 51), 2: (0, 51), 3: (0, 0), 4: (0, 0), 5: (0, 0)}


def test_texts_longer_than_a_part(make_docs, monkeypatch):
    monkeypatch.setattr(suffixes, "PART", 64)
    rows = repeated_texts(random.Random(6))[:20]
    got = suffixes.occurrences(make_docs(rows).selectExpr("doc_id", "doc_id AS key", "coalesce(text, '') AS text"), 40, 12)
    covered = sum(r["far"] - r["near"] + 1 for r in got.collect())
    assert covered == sum(max(0, len(t.encode()) - 39) for _, t in rows)


def test_prefix_ranks_are_suffix_order():
    data = np.frombuffer(b"banana$bandana$banana", np.uint8)
    rank = suffixes.prefix_ranks(data, 20)
    suffix = [data[k:].tobytes()[:20] for k in range(len(data))]
    assert [suffix[k] for k in np.argsort(rank, kind="stable")] == sorted(suffix)


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)]
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == root[k] for k in got) and {k for e in edges for k in e if e[0] != e[1]} == set(got)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline_stages(spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as pipeline
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = pipeline.quality_rules(spark, docs, folder)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
    one = pipeline.jaccard_join(spark, docs, folder)
    pairs = plain_join(sorted(rows.items()))
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(int(a) for a, b, _, _ in pairs if a == b)
    assert [name for name, _ in pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "packing"]
    packed = pipeline.run(spark, folder)
    assert packed.count() > 0 and "sequence_id" in packed.columns
