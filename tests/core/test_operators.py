import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callweave.functions import versions
from callweave.operators import matching, scan, soundness
from callweave.operators.solver import solve
from callweave.plans.fixpoint import closure, reached
from callweave.sources import files


def test_reached_and_closed_against_sets(spark):
    rng = random.Random(2)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(40)}
    d = spark.createDataFrame(sorted(edges), "src long, dst long")
    path = set(edges)
    while more := {(a, d) for a, b in path for c, d in path if b == c} - path:
        path |= more
    assert {tuple(r) for r in closure(d).collect()} == path
    seeds = spark.createDataFrame([(1,), (1,), (None,)], "node long")
    assert {r.node for r in reached(d, seeds).collect()} == {1} | {b for a, b in path if a == 1}
    assert {r.node for r in reached(d, seeds, 1).collect()} == {1} | {b for a, b in edges if a == 1}


def facts(spark, **given):
    kinds = {"resolved": "node string", "callee_of": "ap string, node string", "returns": "fn string, ap string", "edge_arg": "edge string, pos int, ap string", "call_node": "node string, callee string", "param_node": "node string, fn string, pos int", "value_node": "node string, ap string", "pending": "edge string, node string", "edge_target": "edge string, target string"}
    return {k: spark.createDataFrame(given.get(k, []), s) for k, s in kinds.items()}


def ends(spark, **given):
    return {tuple(r) for r in solve(facts(spark, **given))["edge_target"].collect()}


def test_solver(spark):
    fn = [("f",), ("g",), ("h",)]
    of = [("f", "f"), ("g", "g"), ("h", "h"), ("g()", "call g"), ("p0", "param h 0")]
    # main calls g()(), and g returns f
    assert ends(spark, resolved=fn, callee_of=of, returns=[("g", "f")], call_node=[("call g", "g")], pending=[("e", "call g")]) == {("e", "f")}
    # main calls h(f), and h calls its parameter
    assert ends(spark, resolved=fn, callee_of=of, param_node=[("param h 0", "h", 0)], edge_arg=[("e1", 0, "f")], edge_target=[("e1", "h")], pending=[("e2", "param h 0")]) == {("e1", "h"), ("e2", "f")}
    # a property read, whose value is what g() returns
    assert ends(spark, resolved=fn, callee_of=of, returns=[("g", "f")], call_node=[("call g", "g")], value_node=[("prop x", "g()")], pending=[("e", "prop x")]) == {("e", "f")}
    # f returns f, and g() returns g(): it ends
    assert ends(spark, resolved=fn, callee_of=of, returns=[("g", "g()")], call_node=[("call g", "g")], pending=[("e", "call g")]) == set()


def test_versions(spark):
    d = spark.createDataFrame([("1.2.3",), ("v10.0",), ("2.0.0-rc.1+b",), ("x",)], "v string")
    out = d.select(matching.version(F.col("v")).alias("v"), matching.prerelease(F.col("v")).alias("p")).collect()
    assert [(r.v, r.p) for r in out] == [([1, 2, 3], False), ([10, 0, 0], False), ([2, 0, 0], True), ([0, 0, 0], False)]


def test_ranges(spark):
    inside = [("1.5.0", "1.0.0", "2.0.0"), ("1.0.0", "1.0.0", "2.0.0"), ("2.0.0", "1.0.0", "2.0.0"), ("2.9.9", "1", "2"), ("1.2.9", "1.0.0", "1.2"), ("v1.5.0+b7", "1.0.0", "2.0.0"), ("1.0.0-rc.2", "1.0.0-rc.1", "2.0.0"), ("2.0.0-rc.1", "1.0.0", "2.0.0-rc.1"), ("1.0.0-rc.10", "1.0.0-rc.9", "2.0.0"), ("1.0.0-alpha.b", "1.0.0-alpha.9", "1.0.0")]
    outside = [("1.5.0-rc.1", "1.0.0", "2.0.0"), ("2.0.1", "1.0.0", "2.0.0"), ("3.0.0", "1", "2"), ("1.3.0", "1.0.0", "1.2"), ("1.0.0-rc.1", "1.0.0-rc.2", "2.0.0"), ("2.0.0-rc.2", "1.0.0", "2.0.0-rc.1"), ("1.1.0-rc.2", "1.0.0-rc.1", "2.0.0"), ("next", "1.0.0", "2.0.0"), (None, "1.0.0", "2.0.0"), ("1.0.0", None, "2.0.0"), ("1.0.0-a", "1.0.0-a.b", "1.0.0")]
    d = spark.createDataFrame([(*x, True) for x in inside] + [(*x, False) for x in outside], "v string, low string, high string, want boolean")
    assert d.where(versions.within(*[versions.version(F.col(c)) for c in ("v", "low", "high")]) != F.col("want")).collect() == []


def test_scan(spark):
    """The cases of the hand-made fixture: reachable or not, in range or just above, each form of a pattern."""
    adv = [(1, "lib", "0.0.0", "1.2.3", "call <lib>.{a,b} [2, 99]"), (2, "lib", "0.0.0", "1.2.2", "call <lib>.a"), (3, "lib", "0.0.0", "2.0.0", "call <lib>"), (4, "lib", "0.0.0", "2.0.0", "call <lib>()"), (None, "lib", "0.0.0", "2.0.0", "call {<lib>.c,<lib>.a}"), (6, "other", "0.0.0", "9.0.0", "call <other>.a"), (7, "lib", "0.0.0", "2.0.0", "call <lib>.far"), (8, "lib", "0.0.0", "2.0.0", None)]
    facts = [
        spark.createDataFrame(adv, "id int, library string, low string, high string, pattern string"),
        spark.createDataFrame([("lib", "1.2.3"), ("lib", "1.2.3"), ("other", "1.0.0-rc.1")], "library string, version string"),
        spark.createDataFrame([("lib", "a", "f"), ("lib", "b", "g"), ("lib", None, "main"), ("lib", "far", "x"), ("other", "a", "f")], "library string, prop string, fn string"),
        spark.createDataFrame([("main", "made"), ("main", "unmade")], "fn string, returned string"),
        spark.createDataFrame([("f",), ("main",), ("made",)], "node string"),
    ]
    assert {tuple(r) for r in scan.hits(*facts).collect()} == {(1, "lib", "f"), (3, "lib", "main"), (4, "lib", "made"), (None, "lib", "f")}
    assert {tuple(r) for r in scan.alarms(*facts).collect()} == {(1, 1), (3, 1), (4, 1), (None, 1)}
    with pytest.raises(Exception, match="only calls"):
        scan.steps(spark.createDataFrame([("read <lib>.a",)], "pattern string")).collect()


def test_soundness_tallies(spark):
    edge = "edge int, source string, source_file string, target string, target_file string, lines string, is_load boolean"
    observed = [
        (1, "s1", "a.js", "t1", "b.js", "1:2", False),  # a function on these lines
        (2, "s1", "a.js", "t2", "b.js", "8:9", False),  # none
        (3, "s1", "a.js", "t3", "b.js", "8:9", False),  # none, known
        (4, "s1", "a.js", "t4", "../lib/m.js", "1:1", True),  # a module, without ../
        (5, "s1", "a.js", "t5", "n.js", "1:1", True),  # no module
        (6, "s2", "a.js", "t1", "b.js", "1:2", False),  # no such source
        (7, "s3", "a.js", "t1", "b.js", "1:2", False),  # no such source, known
        (8, "s4", "a.js", "t1", "b.js", "1:2", False),  # an open target
        (9, "s1", "runner.js", "t1", "b.js", "1:2", False),  # no test
        (10, "s1", "ignored/a.js", "t9", "b.js", "0:0", False),  # counts as sound
        (11, "s5", "a.js", "t1", "b.js", "1:2", False),  # there, though known to be absent
        (12, "s1", "a.js", "t6", "b.js", "7:7", False),  # moved to 1:2
        (13, "s1", "a.js", "t7", "b.js", "6:6", False),  # alike
        (14, "s1", "a.js", "t8", "w.js", "1:1", True),  # loaded under another name
        (15, "s1", "a.js", "t10", "b.js", "1:2", False),  # found, though known as missing
        (16, "s2", "excused.js", "t1", "b.js", "1:2", False),
    ]
    static = [("s1", "function", "b.js", "1:2", "1:0:2:0"), ("s1", "function", "c.js", "4:5", "4:0:5:1"), ("s1", "module", "/x/lib/m.js", None, None), ("s1", "module", "/x/v.js", None, None), ("s4", "unresolved", None, None, None), ("s4", "function", "b.js", "1:2", None), ("s5", "function", "b.js", "1:2", None)]
    make = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    rules = soundness.Rules(
        make([("s1", "t3"), ("s1", "t10")], "source string, target string"), make([("s3",), ("s5",)], "source string"), make([("t6", "1:2")], "target string, lines string"),
        make([("t8", "/x/v.js")], "target string, file string"), make([("6:6", "c.js", "4:0:5:1")], "lines string, file string, place string"), ("runner",), ("ignored/",), ("excused",),
    )
    o, s = make(observed, edge), make(static, "source string, kind string, file string, lines string, place string")
    kinds = {r.edge: r["class"] for r in soundness.judged(o, s, rules).collect()}
    want = "correct missing_call known_unsound correct missing_load missing_source expected_missing_source unresolved skipped ignored correct correct correct correct unexpectedly_sound missing_source".split()
    assert kinds == dict(enumerate(want, 1))
    got = soundness.tallies(o, s, rules).first().asDict()
    assert got == {"tested": 15, "ignored": 1, "unresolved": 1, "correct": 7, "unexpectedly_sound": 1, "known_unsound": 1, "expected_missing_source": 1, "present_though_absent": 1, "missing_source": 2, "missing_load": 1, "missing_call": 1, "missing_unexcused": 2}
    assert set(soundness.tallies(o.limit(0), s, rules).first()) == {0}


def test_files(spark, tmp_path):
    (tmp_path / "adv.json").write_text(json.dumps([{"library": "l", "versionMin": "1.0.0", "versionMax": "2.0.0", "pattern": "call <l>.a"}]))
    assert files.advisories(spark, str(tmp_path / "adv.json")).first().id is None
    place = lambda s, a: {"source": s, "start": {"line": a, "column": 0}, "end": {"line": a, "column": 9}}
    (tmp_path / "dyn.json").write_text(json.dumps([{"from": place("a.js", 1), "to": place("b.js", 2), "isLoad": False}, {"from": place("runner.js", 1), "to": place("b.js", 2), "isLoad": True}]))
    assert [tuple(r) for r in files.observed_edges(spark, str(tmp_path / "dyn.json")).collect()] == [("a.js:1:1", "b.js:2:2", False)]
    listing = "root@1\n├─ a@1\n│ └─ b@2\n└─ c@3\n  └─ b@2"
    rows = [(0, k, x) for k, x in enumerate(listing.split("\n"))]
    tree = files.tree_edges(spark.createDataFrame(rows, "run long, line_no int, line string"))
    assert {(r.parent, r.child) for r in tree.collect()} == {("root@1", "a@1"), ("a@1", "b@2"), ("root@1", "c@3"), ("c@3", "b@2")}
    files.write_edges(spark.createDataFrame([("x", "y"), ("x", "y")], "source string, target string"), str(tmp_path / "dot"))
    text = lambda name: "\n".join(p.read_text().rstrip() for p in sorted((tmp_path / name).glob("part-*")) if p.read_text())
    assert text("dot") == 'digraph {\n  "x" -> "y";\n}'
    calls = files.labelled(spark.createDataFrame([("x", "y", "f()", "a.js", 3, 7)], "source string, target string, node_key string, file string, sl int, sc int"))
    files.write_graph(spark.createDataFrame([("x", "resolved"), ("y", "unknown")], "node string, node_kind string"), calls, str(tmp_path / "graph"))
    assert text("graph") == 'digraph {\n  "x";\n  "y" [ color = "lightblue", style = "filled" ];\n  "x" -> "y" [ label = "f() a.js:3:7" ];\n}'
    assert files.files(spark, str(tmp_path), "*.json", outside="dyn").count() == 1
