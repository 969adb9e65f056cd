import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callweave.functions import globs, patterns
from callweave.operators import scan
from callweave.sources import files

#: The forms of patterns that advisories come in.
SHIPPED = [
    "call <axios>.get [2, 99]", "call <moment>", "call <lodash>.{defaultsDeep,merge,mergeWith}", "call <lodash>.defaultsDeep", "call <handlebars>.{compile,template}",
    "call {<yargs-parser>,<yargs-parser>.detailed}", "call <debug>()", "call {<marked>,<marked>.Lexer().lex,<marked>.lexer}",
]


def found(parts, path, numbered=True, prefix=False):
    """Every way that a path, or its beginning, is one of the glob's, in the order in which shorter captures come first: (how much, captures)."""
    if not parts:
        return [(0, [])] if prefix or not path else []
    first, rest = parts[0], parts[1:]
    if isinstance(first, globs.Text):
        n = len(first.text)
        return [(n + k, c) for k, c in found(rest, path[n:], numbered, prefix)] if path.startswith(first.text) else []
    if isinstance(first, globs.Name):
        lengths = range((path + "/").index("/") + 1)
    elif isinstance(first, globs.Folders):
        lengths = [i + 1 for i, c in enumerate(path) if c == "/"] if path.startswith("/") else []
    else:
        lengths = [k for g in first.options for k, _ in found(g.parts, path, False, not g.captures)]
    return [(n + k, [path[:n], *c]) for n in lengths for k, c in found(rest, path[n:], numbered, prefix)]


simple = st.one_of(st.sampled_from(["a", "b", "/", "ab", ".", "/a"]).map(globs.Text), st.just(globs.Name()), st.just(globs.Folders()))
nested = st.recursive(
    st.lists(simple, max_size=3), lambda g: st.lists(st.one_of(simple, st.lists(g, min_size=1, max_size=3).map(lambda o: globs.Either(tuple(globs.Glob(tuple(x)) for x in o)))), max_size=3), max_leaves=8
).map(lambda p: globs.Glob(tuple(p)))


@settings(max_examples=400, deadline=None)
@given(nested, st.text("ab/.", max_size=7), st.booleans())
def test_globs_against_backtracking(glob, path, prefix):
    every = found(glob.parts, path, prefix=prefix)
    hit = re.match(glob.regex(prefix), path)
    assert bool(hit) == bool(every)
    if hit:
        assert list(hit.groups()) == every[0][1]


@settings(max_examples=200, deadline=None)
@given(nested)
def test_globs_round_trip(glob):
    assert str(globs.parse(str(glob))) == str(glob)


def test_globs_in_columns(spark):
    d = spark.createDataFrame([("/x/lib/y/a.js",), ("/lib/b.js",), ("/lib/b.jsx",), (None,)], "p string")
    got = d.select(globs.matches(F.col("p"), "/**/{lib,li{c,d}}/**/*.js").alias("m"), globs.captured(F.col("p"), "/**/lib/**/*.js").alias("c"), globs.matches(F.col("p"), "/**/b.js", prefix=True).alias("begins")).collect()
    assert [r.m for r in got] == [True, True, False, None]
    assert got[0].c == {"#1": "/x/", "#2": "/y/", "#3": "a"}
    assert [r.begins for r in got] == [False, True, True, None]


@pytest.mark.parametrize("text", ["{a", "{a,{b}", "{{a}"])
def test_open_braces(text):
    with pytest.raises(ValueError, match="brace"):
        globs.parse(text)


@pytest.mark.parametrize("text", SHIPPED)
def test_shipped_forms_round_trip(text):
    assert str(patterns.parse(text)) == text


name = st.from_regex(r"[a-z][\w$-]{0,4}", fullmatch=True)
path = st.recursive(
    nested.filter(lambda g: g.parts and "." not in str(g)).map(patterns.Module),
    lambda p: st.one_of(st.builds(patterns.Property, p, st.lists(name, min_size=1, max_size=3).map(tuple)), p.map(patterns.Called), st.lists(p, min_size=2, max_size=3).map(lambda x: patterns.Either(tuple(x)))), max_leaves=5,
)


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(patterns.CALLS), path, st.lists(st.tuples(st.integers(0, 9), st.integers(0, 99)), max_size=2).map(tuple))
def test_patterns_round_trip(kind, path, bounds):
    text = str(patterns.Pattern(kind, path, bounds))
    assert str(patterns.parse(text)) == text


def test_pattern_trees():
    p = patterns.parse("call {<a>,{<b>.x,<c>()}.y}.z() [1,2] [ 0 , 3 ]")
    assert isinstance(p.path, patterns.Called)
    assert p.bounds == ((1, 2), (0, 3))
    assert p.path.on.names == ("z",)
    assert patterns.parse("importD /**/x").path.glob == globs.parse("/**/x")
    assert patterns.parse("readO <a.b>.{c, d}").path.names == ("c", "d")


@pytest.mark.parametrize("text", ["", "call", "call x", "{call <a>, call <b>}", "read <a>", "read <a>.b [1,2]", "call <a>.", "call {<a>}", "call <a>.{b", "call <a> [1]", "write <a>.b", "call <a>[1,2]x", "import"])
def test_no_patterns(text):
    with pytest.raises(ValueError):
        patterns.parse(text)


def test_only_installed_patterns_are_read(spark):
    adv = spark.createDataFrame([(1, "a", "1.0.0", "2.0.0", "call {<a>,<a>.x}"), (2, "gone", "0.0.0", "9.0.0", "read <gone>.x"), (3, "a", "3.0.0", "4.0.0", "no pattern"), (None, "a", "0.0.0", "9.9.9", "call <a>.{x,y}"), (None, "a", "0.0.0", "9.9.9", "call <a>()")], "id int, library string, low string, high string, pattern string")
    dep = spark.createDataFrame([("a", "1.5.0"), ("a", "1.6.0")], "library string, version string")
    defs = spark.createDataFrame([("a", None, "main"), ("a", "x", "fx"), ("a", "x", "far"), ("a", "y", "fy"), ("b", "x", "bx")], "library string, prop string, fn string")
    given = spark.createDataFrame([("main", "fy"), ("main", "made")], "fn string, returned string")
    node = spark.createDataFrame([(n,) for n in ("main", "fx", "fy", "bx", "made")], "node string")
    assert {tuple(r) for r in scan.hits(adv, dep, defs, given, node).collect()} == {(1, "a", "main"), (1, "a", "fx"), (None, "a", "fx"), (None, "a", "fy"), (None, "a", "made")}
    assert {tuple(r) for r in scan.alarms(adv, dep, defs, given, node).collect()} == {(1, 2), (None, 3)}
    with pytest.raises(Exception, match="only calls"):
        scan.alarms(adv.where("id = 2"), spark.createDataFrame([("gone", "1.0.0")], "library string, version string"), defs, given, node).collect()


def test_scan_of_recorded_files(spark, tmp_path):
    """Advisories, dependencies and a solved program to alarms, a null id among them, traces and counts."""
    import json

    rows = [{"library": "lib", "versionMin": "0.0.0", "versionMax": "2.0.0", "pattern": "call {<lib>,<lib>.x}", "id": 7}, {"library": "lib", "versionMin": "0.0.0", "versionMax": "2.0.0", "pattern": "call <lib>()"}, {"library": "none", "versionMin": "0.0.0", "versionMax": "2.0.0", "pattern": "read <none>.x", "id": 9}]
    (tmp_path / "adv.json").write_text(json.dumps(rows))
    adv = files.advisories(spark, str(tmp_path / "adv.json")).selectExpr("id", "concat('/n/node_modules/', library) AS library", "versionMin AS low", "versionMax AS high", "pattern")
    dep = spark.createDataFrame([("/n/node_modules/lib", "1.0.0")], "library string, version string")
    f = lambda k: f"FunctionCreation:/n/node_modules/lib/i.js:{k}:0"
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    solution = {"rho": frame([(f(k), f(k)) for k in range(1, 6)] + [("p", f(3))], "node string, target string"), "edge_target": frame([("e1", f(1)), ("e2", f(2)), ("e2-0", f(3)), ("e9", f(4))], "edge string, target string")}
    calls = frame([("e1", "</a.js>", 1), ("e2", f(1), 2), ("e9", f(5), 3)], "edge string, source string, ord int")
    fields = frame([("/n/node_modules/lib/i.js", "exports", f(2)), ("/n/node_modules/lib/i.js", "x", "p"), ("/n/node_modules/lib/i.js", "x", f(4))], "file string, prop string, ap string")
    out = scan.report(solution, frame([("</a.js>",)], "node string"), adv, dep, fields, frame([(f(2), f(1))], "fn string, ap string"), calls)
    assert {tuple(r) for r in out["alarms"].collect()} == {(7, f(2)), (7, f(3)), (None, f(1))}
    assert {tuple(r) for r in out["traces"].where(F.col("fn") == f(3)).collect()} == {(f(3), 0, f(3)), (f(3), 1, f(1)), (f(3), 2, "</a.js>")}
    assert tuple(out["metrics"].first()) == (4, 2, 1)
