import hashlib
import re

from pyspark.sql import functions as F

from callweave.llm import pii
from callweave.llm.pii import op10_personal_data, personal_data

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        s += n - 9 if n > 9 else n
    return s % 10 == 0


def base(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in p.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def expect(text):
    b = base(text or "")
    n = [sum(x.startswith(k + ":") for x in b) for k in PLAIN]
    return (*n, hashlib.sha256(",".join(b).encode()).hexdigest())


ODD = [
    None, "", "a@b.c", "x.y+z@mail-1.example.com.", "a@b.c_d@e.f a@b@c.d", "é😀 q@w.ee 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.2.3.000255",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111", "+1 (017) 555-7713, +49 30 1234567890123456, +1 2, ++1.234.567.890",
    "1 2 3 4 5 6 7 8 9 0 " * 4000, "a" * 60000, "1" * 60000, "1." * 30000, "a@b." * 5000, "+" * 3000 + "1 " * 3000, "99999999999999999999.1.1.1",
    'token = "ede43f42c939b6405768150e0411590525cf889e" x', "bob [at] example [dot] com", "tel 555 123 4567; version 123456789012",
]


def rows(df):
    return sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in df.collect())


def test_base_spans(spark):
    d = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    out = personal_data(d)
    assert rows(out) == sorted((i, *expect(t)) for i, t in enumerate(ODD))
    for r in out.collect():
        got, b = r.spans.split(",") if r.spans else [], base(ODD[r.doc_id] or "")
        assert set(b) <= set(got) and len(got) == len(b) + r.n_added
        ends = [(int(x.split(":")[1]), int(x.split(":")[2])) for x in got if x.split(":")[0] not in PLAIN]
        for s, e in ends:
            assert not any(s < int(x.split(":")[2]) and int(x.split(":")[1]) < e for x in b)


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op10_personal_data(spark, sf)
    assert rows(out) == sorted((i, *expect(t)) for i, t in texts.items())
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_em_finds_the_unreliable_labeler(spark):
    """Five labelers over drawn votes: the fourth says nothing true."""
    import random

    rng = random.Random(1)
    right = [0.95, 0.9, 0.85, 0.5, 0.9]
    votes = {}
    for _ in range(6000):
        y = rng.random() < 0.4
        v = tuple(2 if rng.random() < 0.2 else int(y if rng.random() < r else not y) for r in right)
        votes[v] = votes.get(v, 0) + 1
    d = spark.createDataFrame([([(float(c), list(v)) for v, c in votes.items()],)], "p array<struct<c:double,v:array<int>>>")
    m = d.select(F.expr(pii.reliabilities()).alias("m")).first().m
    assert abs(m.prior - 0.4) < 0.05
    for lab, r in enumerate(right):
        assert abs(m.t[6 * lab + 3 + 1] / (m.t[6 * lab + 3] + m.t[6 * lab + 3 + 1]) - r) < 0.06


def test_classifier_learns_secrets(spark):
    keys = [f'some words then token = "{hashlib.sha1(str(i).encode()).hexdigest()}" and more' for i in range(30)]
    noise = [f"the section chapter-of-things-and-more-{i}-words goes on" for i in range(30)]
    d = spark.createDataFrame(list(enumerate(keys + noise)), "doc_id long, text string")
    out = {r.doc_id: r.spans for r in personal_data(d).collect()}
    assert all("secret" in out[i] for i in range(30)) and not any("secret" in out[i] for i in range(30, 60))


def test_cases(spark):
    d = spark.createDataFrame([(None, "a@b.cd", 1), (1, "a@b.cd", 2), (1, "a@b.cd", 2)], "doc_id long, text string, spans int")
    assert [r.spans for r in personal_data(d).collect()] == ["email:0:6"] * 3
    assert personal_data(d.limit(0)).count() == 0


def test_handles_in_capitals(spark):
    texts = ["JOE [AT] ACME [DOT] COM", "joe (at) acme (dot) com", "JOE (AT) ACME.COM", "JOE [AND] ACME", "Bob [At] Example [Dot] com"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: [x.m for x in r.extra] for r in pii.spans(d).collect()}
    assert got == {0: texts[:1], 1: texts[1:2], 2: texts[2:3], 3: [], 4: texts[4:]}


def test_labelers_take_whole_words(spark):
    """A hotel is no telephone, a monkey no key; telecom is no domain."""
    texts = ["hotel a1@b.com", "tel a1@b.com", "monkey a1@x.telecom", "api_key a1@x.de", "the conversion a1@b.com", "version: a1@b.com"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    votes = {r.i: r.seen[0].v for r in pii.spans(d).select("i", F.expr(pii.seen("base")).alias("seen")).collect()}
    assert [votes[i][1] for i in range(6)] == [1, 1, 0, 1, 1, 1]
    assert [votes[i][2] for i in range(6)] == [2, 1, 2, 1, 2, 2]
    assert [votes[i][3] for i in range(6)] == [2, 2, 2, 2, 2, 0]
