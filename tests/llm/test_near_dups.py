import random
import re
from collections import Counter
from itertools import combinations

import numpy as np

from callweave.llm import near_dups, words
from callweave.llm.groups import components
from callweave.llm.near_dups import near_duplicates, op6_near_duplicates, super_minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(rows, k=5, percent=75):
    """rows: (id, text), ids unique."""
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                a2, b2 = find(a), find(b)
                up[max(a2, b2)] = min(a2, b2)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(1)
    for n, share in ((6, 0.5), (60, 0.8), (3000, 0.3)):
        err = []
        for _ in range(40):
            pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            k = int(n * share)
            a, b = pool[:n], np.concatenate([pool[:k], pool[n : 2 * n - k]])
            s = super_minhash(np.concatenate([a, b]), np.array([0, n, 2 * n]))
            assert not (s == s.max()).all()
            err.append((s[0] == s[1]).mean() - k / (2 * n - k))
        assert abs(np.mean(err)) < 0.03


def test_signature_does_not_depend_on_order_or_company():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (0, 1, 3, 50, 900, 2000)]
    ptr = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    whole = super_minhash(np.concatenate(sets), ptr)
    for k, s in enumerate(sets):
        assert (super_minhash(rng.permutation(s), np.array([0, len(s)]))[0] == whole[k]).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (200, 150)]
    random.Random(3).shuffle(chain)
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long").repartition(7)).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 200: 150, 150: 150}


def test_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op6_near_duplicates(spark, sf).collect())) == brute(rows)


def test_planted_groups(spark):
    """Stars whose arms are linked to the middle only, chains, and copies."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(5000)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([9, 40, 300]))]
        for _ in range(rng.choice([2, 5, 30])):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 40)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append(((n := n + 1) * 7 % 1009, " ".join(t)))
        for _ in range(12):  # a chain of small steps
            base[rng.randrange(len(base))] = rng.choice(vocab)
            rows.append(((n := n + 1) * 7 % 1009, "\n".join(base).upper()))
    assert sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


def test_cases(spark):
    rows = [(1, None, 1), (2, "", 2), (3, " \n", 3), (4, "One two", 4), (5, "one\ttwo ", 5), (6, "two one", 6), (None, "one two", 7), (8, "x " * 200000, 8), (9, "X", None), (9, "X", None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n_shingles int")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (None, 1, None, True), (8, 1, 8, True), (9, 1, 9, True), (9, 1, 9, True)]))
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_chunks():
    import pyarrow as pa

    texts = ["", "a B", " x", "x ", "é\x1f\x00ü Éa", "", "q\vw", "z" * 3_000_000 + " y", "end"]
    got = [[] for _ in texts]
    for w in words.chunks(pa.array(texts)):
        for r in range(len(w.n)):
            got[w.first + r] = [w.word(i).decode() for i in range(w.ptr[r], w.ptr[r + 1])]
    assert got == [WORD.findall(lower(t)) for t in texts]


def test_large_bucket_of_single_documents(spark):
    """Many texts alike, most of them not enough, in one bucket: blocks find the links that are there."""
    import random

    rng = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(300):
        w = list(base)
        for k in rng.sample(range(120), rng.choice([1, 2, 3, 4, 5, 9])):
            w[k] = f"x{i}k{k}"
        texts[i] = " ".join(w)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in texts.items()}
    low = dict(zip(texts, texts, strict=True))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for a in texts:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                low[q] = p
    assert {r.doc_id: r.component_id for r in near_dups.near_duplicates(d).collect()} == {i: find(i) for i in texts}


def test_equals_all_pairs_of_a_larger_table(spark):
    """Every pair that shares a shingle, at sf0.01."""
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    sets, having = {}, {}
    for i, t in docs.items():
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
        for s in sets[i]:
            having.setdefault(s, []).append(i)
    both = Counter((a, b) for ids in having.values() for a, b in combinations(sorted(ids), 2))
    low = {i: i for i in docs}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            p, q = sorted((find(a), find(b)))
            low[q] = p
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op6_near_duplicates(spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in docs}


def test_one_group_of_many(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[: i % 120], f"x{i}", *base[i % 120 + 1 :]])) for i in range(20_000)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert out.where("component_id = 0").count() == 20_000 and out.where("kept").count() == 1


def test_repeated_ids_with_different_texts(spark):
    """The rows of an id are one document, whatever partition they come from."""
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, one), (2, one), (2, two), (3, two), (3, two + " c")]
    for n in (1, 3):
        out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(n))
        assert {(r.doc_id, r.component_id) for r in out.collect()} == {(1, 1), (2, 1), (3, 1)}
