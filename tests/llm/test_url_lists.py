import datetime as dt
from collections import Counter

import duckdb
from callweave.llm.url_lists import OP4_SQL, intervals, judged, op4_url_lists


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    cols = "page_id url fetched key verdict since blocked".split()
    out = op4_url_lists(spark, sf).select(cols)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({OP4_SQL})").fetchall()
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert len({x[4] for x in want}) == 3 and len({x[6] for x in want}) == 2


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def test_cases(spark):
    entries = [("B.com", "block", day(3)), ("b.com", "none", day(5)), ("b.com", "block", day(200)), ("a.b.com/x/", "allow", day(4)), ("b.com", "block", day(5)), (None, "block", day(0)), ("c.com", None, day(0)), ("c.com", "block", None)]
    e = spark.createDataFrame(entries, "key string, verdict string, day date")
    rows = [(k, u, day(n)) for k, (u, n) in enumerate([("http://a.b.com/y", 2), ("http://a.b.com/y", 3), ("http://a.b.com/x/y?z=/", 4), ("http://A.B.com:80", 5), ("http://u@b.com#x", 400), ("http://xb.com/", 400), ("nothing", 9), ("http://c.com", 9)])]
    rows += [(None, None, day(3)), (8, "http://b.com", None), (1, "http://a.b.com/y", day(3))]
    d = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, fetched date, verdict int")
    out = Counter((r.page_id, r.verdict, r.key) for r in judged(d, e).collect())
    assert out == Counter({(0, None, None): 1, (1, "block", "b.com"): 2, (2, "allow", "a.b.com/x/"): 1, (3, None, None): 1, (4, "block", "b.com"): 1, (5, None, None): 1, (6, None, None): 1, (7, None, None): 1, (None, None, None): 1, (8, None, None): 1})
    assert judged(d.limit(0), e).count() == 0 and judged(d, e.limit(0)).where("verdict IS NOT NULL").count() == 0
    assert sorted(map(str, intervals(e).where("key = 'b.com'").collect())) == sorted(map(str, spark.createDataFrame([("b.com", "block", day(3), day(5)), ("b.com", "block", day(200), None)], "key string, verdict string, since date, until date").collect()))


def test_daily_changes(spark):
    e = spark.createDataFrame([("b.com", ["block", "none", "allow"][n % 3], day(n)) for n in range(700)], "key string, verdict string, day date")
    d = spark.createDataFrame([(n, "http://b.com/", day(n)) for n in range(700)], "page_id long, url string, fetched date")
    assert {r.page_id: r.verdict for r in judged(d, e).collect()} == {n: ["block", None, "allow"][n % 3] for n in range(700)}
