"""Secrets, quality, surrogates, urls: small cases and DuckDB."""

import re

import duckdb
import pytest

from defectlens.llm import op1_secrets as secrets
from defectlens.llm import op4_quality as quality
from defectlens.llm import op5_surrogates as pii
from defectlens.llm import op6_urls as urls

LINE = "The quick brown fox jumps over the lazy dog while many other animals look on from the old fence nearby"
OTHER = "Every evening some people walk along a river and talk about the weather of last week or of tomorrow"


def by_duckdb(sql, **tables):
    c = duckdb.connect()
    for name, df in tables.items():
        c.register(name, df.toArrow())
    rows = c.sql(sql)
    names = sorted(rows.columns)
    return sorted((tuple(str(x) for x in r) for r in c.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()))


def by_spark(df):
    names = sorted(df.columns)
    return sorted(tuple(str(r[c]) for c in names) for r in df.collect())


WORDS = ("configuration parameter international service request handler connection between several machines which answer questions about "
         "weather music history language science travel kitchen garden window mountain river village market teacher student engine").split()
LONG = " ".join(WORDS[k * k % len(WORDS)] + WORDS[k * 7 % len(WORDS)] for k in range(400)) + " "
SECRETS = [None, "", "no secret here", "password=abcdef", "passwd: 'abc'", 'Token = "0123456789abcdef0123456789abcdef"', "token=token: abcdefgh",
           "SECRET:x api_key=ABCDEFG/+9 apikey : zzzzzz", "AKIA" + "A1" * 8, "AKIA" + "A1" * 7, "xAKIAAKIA" + "B2" * 10, "é" * 5 + " " + "deadbeef" * 3,
           "deadbeef" * 2 + "deadbee", LONG + "password=" + "q" * 30, "K\u212aen=abcdefgh \u017fecret=abcdefgh",
           "see 9fKq2LzXv7Rt0WcYb3Nd8HsJm5Pg1QaE here", "internationalization_of_configuration_parameters", LINE]


def test_secrets_equal_sql(make_docs):
    docs = make_docs([(k, t) for k, t in enumerate(SECRETS)] + [(None, SECRETS[3]), (2, SECRETS[5]), (2, SECRETS[5])])
    got = secrets.secret_report(docs)
    assert by_spark(got) == by_duckdb(secrets.ORACLE, documents=docs.select("doc_id", "text"))
    spans = {r["doc_id"]: r["spans"] for r in got.collect()}
    assert spans[3] == "assign:0:15" and spans[4] == "" and spans[6] == "" and spans[11] == "hex:6:30" and spans[14] == ""
    assert "markov" in spans[15] and spans[16] == ""
    assert secrets.secret_report(make_docs([])).count() == 0


def test_redact_masks_the_spans_only(make_docs):
    docs = make_docs([(k, t) for k, t in enumerate(SECRETS)])
    got = secrets.redact(docs)
    assert got.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts[0] is None and texts[1] == "" and texts[2] == SECRETS[2] and texts[3] == "[REDACTED]" and texts[11] == "é" * 5 + " [REDACTED]"
    assert texts[5] == "[REDACTED]\"" and texts[13] == LONG + "[REDACTED]"


def test_markov_ratio_separates_held_out_strings(spark):
    import hashlib
    import random
    rng = random.Random(4)
    words = re.findall(r"[a-z]+", (LINE + " configuration parameters international service request handler connection").lower())
    ordinary = ["_".join(rng.choices(words, k=4)) for _ in range(400)]
    samples_of = LONG.split()
    secret = [hashlib.sha256(str(k).encode()).hexdigest()[:32] for k in range(200)] + ["".join(rng.choices(secrets.ALPHABET[:62], k=28)) for _ in range(200)]
    samples = spark.createDataFrame([(v, 0) for v in ordinary[::2] + samples_of] + [(v, 1) for v in secret[::2]], "value string, label int")
    model = secrets.train(samples).first()["w"]
    at = {c: k for k, c in enumerate(secrets.ALPHABET)}
    score = lambda v: sum(model[at[a] * 67 + at[b]] for a, b in zip(v, v[1:]))
    right = [score(v) < secrets.THRESHOLD for v in ordinary[1::2]] + [score(v) >= secrets.THRESHOLD for v in secret[1::2]]
    assert sum(right) / len(right) > 0.97


QUALITY = [None, "", " \n\t ", LINE, "\n".join([LINE, "a | b | c | d | e", "All rights reserved.", OTHER + "!!!!"]), "\n".join([LINE] * 3),
           "\n".join([LINE, LINE + " x", LINE + " y"]), " ".join(["w"] * 40), "*** $$$ %%% " * 30, "THE!! DOG!! RAN!! " * 20 + "\n" + LINE,
           "\u00a0".join(["w"] * 40), "a\tb\u000bc\r\nd " * 10, LINE * 200, "x | y\n" * 30]


def test_quality_equal_sql(make_docs):
    docs = make_docs([(k, t) for k, t in enumerate(QUALITY)] + [(None, LINE), (3, LINE), (3, LINE)])
    got = quality.quality_report(docs)
    assert by_spark(got) == by_duckdb(quality.ORACLE, documents=docs.select("doc_id", "text"))
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[3]["kept"] and not rows[8]["kept"] and not rows[0]["kept"] and rows[5]["n_dup_lines"] == 2
    assert quality.quality_report(make_docs([])).count() == 0


def test_keep_clean_removes_lines_then_documents(make_docs):
    docs = make_docs([(k, t) for k, t in enumerate(QUALITY)])
    got = quality.keep_clean(docs)
    assert got.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts[3] == LINE and texts[4] == LINE + "\n" + OTHER + "!!!!" and 8 not in texts and 0 not in texts
    assert set(texts) == {r["doc_id"] for r in quality.quality_report(docs).collect() if r["kept"]}


PII = [None, "", "nothing to find in 1999 or 12-34", "Mail John.Doe@mail.example.com or john.doe@MAIL.example.com, call (499) 555-6503 / 499-555-6503.",
       "card 4111 1111 1111 1111 and 4111111111111111, not 4992883091964172", "host 14.209.33.77 and 14.209.33.770 and 1.2.3.4.5",
       "id 123-45-6789", "Mr. John Smith met Mrs. Anna Smith; Mr Smith left. господин Иван Петров", "+1 (743) 555-3824"]


def test_surrogates_keep_type_identity_and_format(make_docs):
    docs = make_docs([(k, t) for k, t in enumerate(PII)] + [(None, PII[3]), (3, PII[3])])
    got = pii.surrogate_report(docs, "a key").collect()
    texts = {r["doc_id"]: r for r in got}
    assert [r["text"] for r in got].count(texts[3]["text"]) == 3 and texts[0]["text"] == "" and texts[2]["text"] == PII[2]
    new = texts[3]["text"]
    mails = re.findall(r"\S+@[A-Za-z0-9.]+", new)
    assert mails[0].lower() == mails[1].lower().rstrip(",") and "Doe" not in new and texts[3]["n_email"] == 2
    phones = re.findall(r"\(\d{3}\) \d{3}-\d{4}|\d{3}-\d{3}-\d{4}", new)
    assert len(phones) == 2 and re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1]) != "4995556503"
    a, b, c = re.findall(r"\d[\d ]{14,}\d", texts[4]["text"])
    assert a.replace(" ", "") == b and pii.check_digit(b[:-1]) == b[-1] and c != "4992883091964172"
    assert texts[6]["text"] != PII[6] and re.fullmatch(r"id \d{3}-\d{2}-\d{4}", texts[6]["text"])
    names = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+); Mr (\w+) left\. господин ([А-Яа-я]+) ([А-Яа-я]+)", texts[7]["text"]).groups()
    assert names[1] == names[3] == names[4] and len({names[0], names[1], names[2]}) == 3 and not {"John", "Smith", "Anna"} & set(names)
    assert texts[8]["text"].startswith("+1 (")
    assert pii.surrogate_report(make_docs([]), "k").count() == 0
    again = pii.replace(docs, "a key", sent=-1).select("new_text").collect()  # the joined way
    assert sorted(r["new_text"] for r in again) == sorted(r["text"] for r in got)
    assert pii.replaced(docs, "a key").columns == docs.columns


def test_surrogates_are_distinct(spark):
    forms = [("ssn", f"{k:02d}") for k in range(80)]  # 90 free two-digit numbers or so: many collisions
    found = spark.createDataFrame([("phone", f"{k:03d}") for k in range(300)], "kind string, form string")
    rows = pii.resolved(found, "k").collect()
    assert len({r["surrogate"] for r in rows}) == 300 and not {r["surrogate"] for r in rows} & {r["form"] for r in rows}
    assert max(r["attempt"] for r in rows) > 0 and forms


URLS = [None, "", "no scheme", "http://a.org/x", "HTTP://Sub.EXAMPLE.org/es/1?q#f", "http://example.org/en/1", "http://example.org/en/2", "http://org",
        "http://notexample.org", "http://x.com/fr/1", "http://x.com/de/1", "http://x.com/de", "http://com/de/1", "http://xcom/de/1", "http://h?x=/de/", "a://b://c/d", "://"]


def test_url_rules(spark):
    df = spark.createDataFrame([(k, u, "z") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    model = urls.Trees(-1.0, [], spark.createDataFrame([], "suffix string, suffix_permille int"), 0)
    got = {r["page_id"]: r for r in urls.judged(df, model).select("row.page_id", "host", "path", "rule", "verdict").collect()}
    for k, u in enumerate(URLS):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0].lower()
            path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, "allow")
        assert (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == (host, path, rule, verdict)
    assert urls.keep_allowed(df).columns == df.columns
    assert urls.url_report(df.limit(0)).count() == 0


def test_url_trees_on_held_out_urls(spark):
    import random
    rng = random.Random(3)
    words = "apple river stone cloud garden paper window silver".split()
    good = [f"https://{rng.choice(words)}{rng.choice(words)}.net/{rng.choice(words)}/{rng.randint(1, 99)}" for _ in range(400)]
    bad = [f"http://{rng.choice(words)}-{rng.choice(words)}-{rng.randint(100, 9999)}.net/{'/'.join(rng.choices(words, k=4))}?{'&'.join(f'p{k}={rng.random()}' for k in range(3))}" for _ in range(400)]
    rows = [(u, 0) for u in good] + [(u, 1) for u in bad]
    rng.shuffle(rows)
    model = urls.train(spark.createDataFrame(rows[:500], "url string, label int"), trees=4)
    test = spark.createDataFrame(rows[500:], "url string, label int")
    got = urls.judged(test, model, rules=()).select("row.label", "verdict").collect()
    assert sum((r["verdict"] == "block") == (r["label"] == 1) for r in got) / len(got) > 0.95


def test_url_trees_equal_a_plain_version(spark):
    """Margins from the expressions equal a walk through the trees."""
    rows = [(f"http://h{k}{'-' * (k % 3)}.net/{'a/' * (k % 5)}{k}", int(k % 3 == 2)) for k in range(200)]
    model = urls.train(spark.createDataFrame(rows, "url string, label int"), trees=2)
    df = model.with_suffix(urls.lexical(spark.createDataFrame(rows, "url string, label int"))).withColumn("m", model.margin())
    for r in df.collect():
        m = model.bias
        for t in model.trees:
            k = 1
            while k in t["splits"]:
                f, x = t["splits"][k]
                k = 2 * k + (r[f] > x)
            m += t["values"].get(k, 0.0)
        assert m == pytest.approx(r["m"])


@pytest.mark.parametrize("hot", ["http://hot2.net/", "http://hot7.net/", "http://hot31.net/"])
def test_one_url_with_most_rows_leaves_the_sample_whole(spark, monkeypatch, hot):
    """Distinct urls fill the bound, whatever the digest of the url that holds most rows; its rows are its weight."""
    monkeypatch.setattr(urls, "MAX_LABELLED", 300)
    good = spark.range(2000).selectExpr("concat('http://site', id, '.net/a') AS url", "0 AS label")
    bad = spark.range(1000).selectExpr("concat('http://x-', id, '-', id, '.net/a/b/c/d?p=', id) AS url", "1 AS label")
    many = spark.range(5000).selectExpr(f"'{hot}' AS url", "0 AS label")
    nulls = spark.createDataFrame([(None, 0), (None, None), ("http://x", 2)], "url string, label int")
    model = urls.train(good.union(bad).union(many).union(nulls), trees=2)
    assert len(model.trees) == 2 and all(t["splits"] for t in model.trees)
    counts = {(r["label"], r["verdict"]): r["urls"] for r in urls.held_out(good.union(bad).union(many)).collect()}
    right = counts.get((0, "allow"), 0) + counts.get((1, "block"), 0)
    assert 500 < sum(counts.values()) < 700 and right / sum(counts.values()) > 0.98
    pages = good.limit(3).withColumn("page_id", urls.F.monotonically_increasing_id())
    assert {r["verdict"] for r in urls.url_report(pages, bad.union(good)).collect()} == {"allow"}
