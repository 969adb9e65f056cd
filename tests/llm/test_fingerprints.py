import hashlib
import re

import pytest

from callweave.llm.fingerprints import ANCHORS, CHAIN, alike, fingerprints, lengths, likeness, op7_alike, op7_fingerprints, shortest, signatures

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    """The signatures as tuples of words."""
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    common = set(ANCHORS.split())
    out = set()
    for i, x in enumerate(w):
        tail = [y for y in w[i + 1 :] if y not in common][:CHAIN] if x in common else []
        if len(tail) == CHAIN:
            out.add((x, *tail))
    if not out and len(w) > CHAIN:
        out = {tuple(w[i : i + CHAIN + 1]) for i in range(len(w) - CHAIN)}
    return out or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(out, docs):
    order = sorted(docs)
    assert sorted(r.doc_id for r in out) == order
    sets = {i: plain(t) for i, t in docs.items()}
    for r in out:
        t, nxt = docs[r.doc_id], order[(order.index(r.doc_id) + 1) % len(order)]
        k = len(t) // 4
        edited = t[: len(t) - k] + docs[nxt][:k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(sets[r.doc_id], plain(edited))) < 1e-9
        assert abs(r.near_next - jaccard(sets[r.doc_id], sets[nxt])) < 1e-9
        assert len(r.fingerprint) == 8 * len(sets[r.doc_id])


def test_query(spark, sf):
    check(op7_fingerprints(spark, sf).collect(), {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()})


def test_many_bins(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 3 > 0").repartition(5)
    check(fingerprints(d, bin_rows=7).collect(), {r.doc_id: r.text for r in d.collect()})


def test_cases(spark):
    d = spark.createDataFrame([(1, None, 1), (2, "é" * 9, 2), (7, "a b", 3)], "doc_id long, text string, bin int")
    check(fingerprints(d, bin_rows=1).collect(), {1: "", 2: "é" * 9, 7: "a b"})
    one = fingerprints(d.where("doc_id = 7")).collect()
    assert one[0].near_next == 1 and len(one) == 1
    again = d.union(d.where("doc_id = 2")).union(spark.createDataFrame([(None, "x", 1), (None, "x", 1)], d.schema))
    assert len(fingerprints(again, bin_rows=1).collect()) == 6
    assert len(fingerprints(again.where("doc_id IS NULL")).collect()) == 2
    assert fingerprints(d.limit(0)).count() == 0


def test_pruned():
    a, b = signatures(["the one two of three four"])[0], signatures(["the one two"])[0]
    assert likeness(a, b) == 0.5 and likeness(a, b, 0.6) == 0.0


def grouped(docs, least):
    """The smallest id that links lead to, every pair compared."""
    sets = {i: plain(t) for i, t in docs.items()}
    home = {i: i for i in docs}
    for i in docs:
        for j in docs:
            if i < j and home[i] != home[j] and sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= least:
                low, high = sorted((home[i], home[j]))
                home = {k: low if v == high else v for k, v in home.items()}
    return home


def test_alike_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.component_id for r in op7_alike(spark, sf).collect()}
    assert got == grouped(docs, 0.75) and len(set(got.values())) < len(docs)


@pytest.mark.parametrize("least, block", [(0.75, 1 << 17), (0.75, 60), (0.4, 200), (1.0, 60)])
def test_alike_far_apart(spark, least, block):
    say = lambda words: " ".join(f"the {w} x{w}" for w in words)
    docs = {1000 * (i % 7) + i: say(range(5 * (i % 5), 5 * (i % 5) + 6 + i)) for i in range(30)}
    docs |= {20_000 + 13 * i: say(["hot", *(f"{i}u{j}" for j in range(i % 3 + 1))]) for i in range(25)}
    docs |= {50_000: docs[1001], 50_001: "", 50_002: "solo"}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in alike(d, least=least, block_bytes=block).collect()}
    assert got == grouped(docs, least)


def test_alike_cases(spark):
    one, two = "the a1 b1 the c1 d1", "the a2 b2 the c2 d2"
    d = spark.createDataFrame([(3, one, 1), (5, one, 1), (5, two, 1), (9, two, 1), (None, one, 1), (7, None, 1)], "doc_id long, text string, rep int")
    out = sorted(((r.doc_id, r.component_id, r.kept) for r in alike(d).collect()), key=str)
    assert out == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 7, True), (9, 3, False), (None, None, True)]
    assert alike(d.limit(0)).count() == 0


def test_lengths():
    for least in (0.3, 0.55, 0.75, 0.9):
        at = lengths(3000, least)
        part = [sum(a <= n for a in at) for n in range(3001)]
        assert all(part[n] - part[shortest(n, least)] <= 1 for n in range(1, 3001)) and len(at) > 2
        assert all(shortest(n, least) == next(m for m in range(1, n + 1) if m / n >= least) for n in range(1, 300))
