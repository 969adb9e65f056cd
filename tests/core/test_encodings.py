"""Each query's rows change when its operator is taken out: else the SQL that they are held against would prove nothing."""

import glob
from pathlib import Path

import duckdb
import pytest

from callweave.catalog import ORACLE_SQL
from callweave.catalog_program import QUERIES

REACHED = " IN (SELECT node FROM reach)"
#: query: what of its SQL stands for the operator, and what stands there without it.
TAKEN_OUT = {
    "op_reach": [("UNION SELECT dst FROM reach JOIN call ON node = src", ""), ("WHERE p_size = 1", "")],
    "op_reach_edges": [("src" + REACHED, "true")],
    "op_reach_all_usages": [("WHERE p_size <= 5", "")],
    "op_reach_metrics": [("node" + REACHED, "true")],
    "op_modules_reached": [("node" + REACHED, "true"), ("module LIKE 'Brand#1%'", "true")],
    "op_used_modules": [("node IN (SELECT node FROM reach) OR", "true OR"), ("OR node IN (SELECT main FROM home", "OR false AND node IN (SELECT main FROM home"), ("WHERE root = 'import'", "")],
    "op_scan_alarms": [("node" + REACHED, "true"), ("AND dep.version BETWEEN low AND high", ""), ("USING (library, prop)", "USING (library)")],
    "op_scan_patterns": [("fn" + REACHED, "true"), ("form = 2", "false"), ("form = 1", "false"), ("form = 0", "false"), ("WHERE p_partkey % 10 <> 1", "")],
    "op_scan_report": [("AND fn IN (SELECT node FROM walk)", ""), ("WHERE s_nationkey >= 5", ""), ("UNION SELECT dst FROM walk JOIN ends ON src = node", ""), ("WHERE src IN (SELECT node FROM walk)", "")],
    "op_side_effect": [("IN (SELECT node FROM reach)", "IS NOT NULL"), ("l_tax >= 0.07 AND", "")],
    "op_pattern_matches": [("AND def", ""), ("AND NOT EXISTS", "AND EXISTS"), ("OR (c.kind = 'prop' AND c.name = 'bind'", "OR (false")],
    "op_bracketed_edges": [("WHEN hook = 'require' AND k >= 90 THEN false", ""), ("AND on_ THEN 'call'", "THEN 'call'"), ("AND on_ THEN 'load'", "THEN 'load'")],
    "op_alias_cap": [("n > 10", "false"), ("n > 10", "true")],
    "op_getter": [("JOIN word w USING (prop)", "CROSS JOIN word w")],
    "op_field_exact": [("r.p_brand = w.p_brand", "true"), ("r.prop = w.prop", "true")],
    "op_field_wild": [("starts_with(prop, t)", "true"), ("suffix(prop, t)", "false")],
    "op_wild_reads": [("starts_with(prop, t)", "true"), ("suffix(prop, t)", "false")],
    "op_listener": [("SELECT DISTINCT e.id AS emit, o.id AS callback FROM e JOIN o ON CASE", "SELECT DISTINCT e.id AS emit, o.id AS callback FROM e JOIN o ON true OR CASE"), ("THEN e.t = o.t", "THEN false"), ("WHEN e.kind = 'prefix' THEN false", "WHEN e.kind = 'prefix' THEN true")],
    "op_callees": [("UNION SELECT l.ap, c.node FROM callee c JOIN leads l ON l.onto = c.ap", ""), ("p.name = 'bind'", "false"), ("p.name = 'assign'", "false"), ("(name = 'Object' OR root_file = 'BUILT_IN')", "false")],
    "op_edge_seeds": [("UNION SELECT l.ap, c.node FROM callee c JOIN leads l ON l.onto = c.ap", ""), ("WHEN 'prop' THEN 'GETTER<' || name || '>' ELSE node_key END AS node", "ELSE node_key END AS node")],
    "op_program_edges": [("UNION SELECT edge, node FROM heard", ""), ("WHERE tax = 0.01 AND q <= 9", "WHERE false"), ("WHERE tax = 0.01 AND q <= 2", "WHERE false"), ("AND fn.module = scope WHERE tax = 0", "AND fn.module = scope WHERE false"), ("AND fn.module = scope", "")],
    "op_resolved_modules": [("UNION ALL SELECT folder, spec, o, r, base || main || e FROM wanted JOIN main USING (base),", "UNION ALL SELECT folder, spec, o, r, base || main || e FROM wanted JOIN main USING (base) JOIN (SELECT 1) ON false,"), ("(1, '/' || host)", "(1, '/gone')"), ("(2, '.json')", "(2, '.gone')")],
}


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def tables(request):
    con = duckdb.connect()
    for path in glob.glob(f"/root/testdata/{request.param}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return con


def rows(con, sql):
    return sorted(map(str, con.sql(sql).fetchall()))


@pytest.mark.parametrize("name", TAKEN_OUT)
def test_rows_change_without_the_operator(tables, name):
    assert name in QUERIES
    whole = rows(tables, ORACLE_SQL[name])
    assert whole
    for part, instead in TAKEN_OUT[name]:
        if part not in ORACLE_SQL[name]:
            raise AssertionError(f"{name} has no {part}")
        assert rows(tables, ORACLE_SQL[name].replace(part, instead)) != whole, (name, part)


def test_traces_end_at_different_steps(tables):
    ends = tables.sql(f"SELECT last, count(*) FROM (SELECT target, max(step) AS last FROM ({ORACLE_SQL['op_stack_trace']}) GROUP BY target) GROUP BY last").fetchall()
    assert len(ends) == 11
    assert max(n for _, n in ends) < 0.9 * sum(n for _, n in ends)
