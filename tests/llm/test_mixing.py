import re
from fractions import Fraction

import duckdb
import pytest

from callweave.llm.mixing import OP5_SQL, mix, op5_mixing, targets


def fill(sizes, epochs=3):
    """Rounds of clamping in exact fractions."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    got, free, left = {}, set(names), Fraction(sum(sizes.values()))
    while free:
        line = left / sum(weight[s] for s in free)
        over = {s for s in free if line * weight[s] > epochs * sizes[s]}
        if not over:
            return got | {s: line * weight[s] for s in free}
        for s in over:
            got[s] = Fraction(epochs * sizes[s])
            left -= got[s]
        free -= over
    return got


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, "c": 1, None: 500}, {"x": 0, "y": 7}, {"é": 3, "z": 3, "Z": 3, "": 1000, "q": 2, None: 1}, {"a": 0}, {"only": 5}])
def test_water_filling(spark, sizes):
    rows = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = fill(sizes)
    assert {r.source: r.target for r in rows} == pytest.approx({s: float(t) for s, t in want.items()})


def test_query_and_sql(spark, sf):
    got = sorted(map(tuple, op5_mixing(spark, sf).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = con.sql(OP5_SQL)
    assert list(rel.columns) == op5_mixing(spark, sf).columns
    assert got == sorted(rel.fetchall())
    by = {}
    for r in op5_mixing(spark, sf).collect():
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.whole * r.size + r.part
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(t - 1 <= n <= t for t, n in by.values())


def test_layout_does_not_matter(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(map(tuple, mix(d.repartition(7)).collect())) == sorted(map(tuple, mix(d.coalesce(1)).collect()))


def test_cases(spark):
    rows = [(1, "a b", "s", 1), (1, "a b", "s", 1), (None, "a", None, 2), (3, None, "s", 3), (4, "", "t", None), (5, " x\x0b\x1f y ", "u", 5), (6, "w " * 50000, "u", 6)]
    out = mix(spark.createDataFrame(rows, "doc_id long, text string, source string, size int")).collect()
    assert len(out) == len(rows)
    sizes = {"s": 4, None: 1, "t": 0, "u": 50003}
    want = fill(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]))
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", next(x[1] or "" for x in rows if x[0] == r.doc_id)))
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
