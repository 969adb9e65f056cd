from collections import Counter

import duckdb
import pytest

from callweave.catalog import ORACLE_SQL
from callweave.catalog_program import QUERIES

SF = "/root/testdata/sf0.001"


def same(v):
    return round(v, 6) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", QUERIES)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    out = QUERIES[name](spark, SF)
    cols = sorted(out.columns)
    assert cols == sorted(want.columns)
    rows = want.project(", ".join(f'"{c}"' for c in cols)).fetchall()
    assert rows and Counter(tuple(map(same, r)) for r in out.select(cols).collect()) == Counter(tuple(map(same, r)) for r in rows)


def test_every_row_takes_part(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    parts = {r.p_partkey for r in read("part").collect()}
    assert {r.ap for r in QUERIES["op_field_exact"](spark, SF).select("ap").distinct().collect()} == parts
    assert {r.ap for r in QUERIES["op_getter"](spark, SF).select("ap").distinct().collect()} == parts
    fns = {r.l_partkey * 100 + int(r.l_quantity) for r in read("lineitem").select("l_partkey", "l_quantity").distinct().collect()}
    assert {r.target for r in QUERIES["op_stack_trace"](spark, SF).select("target").distinct().collect()} == fns
    assert {r.callback for r in QUERIES["op_listener"](spark, SF).select("callback").distinct().collect()} <= parts
