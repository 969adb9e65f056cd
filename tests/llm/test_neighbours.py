import numpy as np

from callweave.llm import neighbours as nb

SCHEMA = "vec_id long, embedding array<float>, rank int, u long, part string"


def brute(rows, asked, k):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for i, v in {(i, v) for i, v in ok if asked(i)}:
        found = []
        for j, x in ok:
            s = 0.0
            for a, b in zip(np.float32(v).tolist(), np.float32(x).tolist(), strict=True):
                s += a * b
            found.append((-s, j))
        found = [f for f in sorted(set(found)) if f[1] != i][:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


def found(spark, rows, k=3, recall=1.0):
    df = spark.createDataFrame([(i, v, 1, 2, "p") for i, v in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in nb.neighbours(df, df.where("vec_id % 5 = 0"), k, recall=recall).collect())


def made(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, np.float32(v).tolist()) for i, v in enumerate(rng.standard_normal((n, 4)))]


def odd():
    same = [1.0, 2.0, 3.0, 4.0]
    rows = [(1000 + i, same) for i in range(100)]  # copies: ties by id
    rows += [(2000 + i, [float(i % 3), 1.0, 0.0, 0.0]) for i in range(30)]
    return rows + [(0, None), (None, same), (5, [None, 1.0, 1.0, 1.0]), (10, [float("nan"), 1.0, 1.0, 1.0]), (15, [0.0] * 4), (20, [float("inf")] + [1.0] * 3), (25, [1.0, 2.0]), (30, []), (35, same), (35, same)]


def test_equals_brute_force_where_all_parts_are_asked(spark):
    rows = [r for r in made(600) if r[0] >= 40] + odd()
    got = found(spark, rows)
    assert got == brute(rows, lambda i: i % 5 == 0, 3)


def test_rows_with_one_id(spark):
    """Vectors with one id but other components are rows of their own, never each other's neighbours."""
    rows = [(5, [1.0, 0.0, 0.0, 0.0]), (5, [1.0, 1.0, 0.0, 0.0]), (6, [1.0, 0.5, 0.0, 0.0])]
    assert found(spark, rows) == [(5, 1, 6, 1.0), (5, 1, 6, 1.5)]


def test_fewer_than_k_and_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(5, [1.0, 0.0, 0.0, 0.0])]) == []
    assert found(spark, [(5, [1.0, 0.0, 0.0, 0.0]), (7, [-1.0, 0.0, 0.0, 0.0])]) == [(5, 1, 7, -1.0)]


def test_recall_and_small_blocks(spark, monkeypatch):
    """Every query has k rows, nine tenths of the nearest among them, though few parts are asked and blocks are small."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 4)) * 4
    rows = [(i, np.float32(centres[i % 12] + rng.standard_normal(4) * 0.3).tolist()) for i in range(2000)]
    monkeypatch.setattr(nb, "BLOCK_ROWS", 50)
    monkeypatch.setattr(nb, "SAMPLE", 500)
    got = found(spark, rows, 10, nb.RECALL)
    want = brute(rows, lambda i: i % 5 == 0, 10)
    assert len(got) == len(want) == 4000
    assert len({(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}) >= 0.9 * len(want)
    exact = {(q, v): s for q, _, v, s in want}
    assert all(exact.get((q, v), s) == s for q, _, v, s in got)


def test_parts_are_balanced_and_cut_fewer_edges():
    x = np.random.default_rng(2).standard_normal((1000, 8))
    near = nb.graph(x, 10)
    start = nb.bisected(x, 7)
    part = nb.balanced(near, start, 7)
    assert np.bincount(start, minlength=7).min() >= 1000 // 7 - 3
    assert np.bincount(part, minlength=7).max() <= np.ceil(1000 / 7 * 1.1)
    assert (part[near] == part[:, None]).mean() > (start[near] == start[:, None]).mean()
    assert (nb.bisected(np.ones((10, 3)), 3) >= 0).all()


def test_few_parts_are_asked_where_vectors_are_grouped():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((16, 32)) * 3
    x = centres[rng.integers(16, size=3000)] + rng.standard_normal((3000, 32)) * 0.3
    ids = np.arange(3000)
    assert nb.fitted((ids, ids, x), 16).probes <= 4
