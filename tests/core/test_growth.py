"""What queries shuffle and how often they do it, as tables grow."""

import os
import re
import time

import pandas as pd
from pyspark.sql import functions as F

from callweave import session
from callweave.catalog_facts import solver_facts
from callweave.catalog_program import QUERIES, program
from callweave.operators import construct, graph, lookups, matching, paths, pattern_match, scan, solver, soundness
from callweave.plans import fixpoint as rounds
from callweave.plans.fixpoint import fixpoint
from callweave.streaming import live

SF = "/root/testdata/sf0.001"


def shuffled(spark, run):
    """Rows that run() writes to shuffles, and what it returns."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)
    stages = lambda: store.stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    ids = lambda s: [(s.apply(k).stageId(), s.apply(k).attemptId(), s.apply(k).shuffleWriteRecords()) for k in range(s.size())]
    before = {x[:2] for x in ids(stages())}
    out = run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for *key, n in ids(stages()) if tuple(key) not in before), out


def test_pairs_of_equal_ids_are_not_shuffled(spark):
    rows = spark.range(300).repartition(3).selectExpr("id AS read", "0 AS module", "explode(array('a', 'b', 'c')) AS prop")
    n, out = shuffled(spark, lambda: lookups.fields(rows, rows.withColumnRenamed("read", "ap")).count())
    assert (out, n < 10_000) == (90_000, True), n
    scope, writes = spark.range(300).repartition(3).selectExpr("id AS module", "'n' AS member"), spark.range(300).repartition(3).selectExpr("'n' AS module", "'p' AS prop", "id AS ap")
    n, out = shuffled(spark, lambda: lookups.scoped(writes, scope).count())
    assert (out, n < 10_000) == (90_000, True), n


def test_large_sets_of_keys_and_missing_values(spark, monkeypatch):
    monkeypatch.setattr(lookups, "SET", 2)
    monkeypatch.setattr(lookups, "BLOCK", 2)
    reads = [(r, m, p) for r in (1, 2, 3, None) for m in (0, 1) for p in "abc"[: (r or 1)]] + [(4, 0, None), (5, 7, "a")]
    writes = [(m, p, a) for a in (1, 2, 3, 4, 5, None) for m in (0,) for p in "bcd"[: (a or 1) % 3 + 1]] + [(0, None, 9), (None, "a", 9)]
    out = lookups.fields(spark.createDataFrame(reads, "read long, module long, prop string"), spark.createDataFrame(writes, "module long, prop string, ap long")).collect()
    want = {(r, a) for r, m, p in reads for n, q, a in writes if m == n and p == q and p is not None}
    assert len(out) == len(want) and {tuple(x) for x in out} == want


def test_imports_are_asked_once_for_a_folder(spark):
    plan = QUERIES["op_resolved_modules"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, \(host#\d+ = host#\d+\)\n[ :+-]*Aggregate \[host", plan)


def test_levels_of_paths_are_not_looked_up(spark, monkeypatch):
    """Where each path is one row, levels are written once, dealt by what they stand on where there are many; paths of two rows are sets still."""
    place = "named_struct('sl', 1, 'sc', 0, 'el', 1, 'ec', 9) AS place"
    at = lambda d: d.selectExpr("concat('p', id) AS ap", "IF(id % 5 = 0, 'import', IF(id % 2 = 0, 'prop', 'call')) AS kind", "IF(id % 5 = 0, null, concat('p', id - 1)) AS on", "concat('m', id) AS name", "'/f.js' AS file", "'/t.js' AS target", place)
    once = at(spark.range(1_000))
    asked = []
    monkeypatch.setattr(paths, "fixpoint", lambda *a, **k: asked.append(1) or fixpoint(*a, **k))
    plain = sorted(map(tuple, paths.rooted(once).collect()))
    assert len(plain) == 1_000 and not asked
    monkeypatch.setattr(session, "DEAL", 10)
    assert sorted(map(tuple, paths.rooted(once).collect())) == plain and not asked
    assert sorted(map(tuple, paths.rooted(once.union(once)).collect())) == plain and asked
    assert set(paths.with_keys(once).columns) == {*once.columns, *paths.rooted(once).columns}


def test_counts_of_a_graph_do_not_double_its_rows(spark):
    rows = spark.createDataFrame([(None, 1, 2), ("a", None, 2), ("b", 1, 2), ("b", 3, None)], "edge string, source long, target long")
    out = graph.graph_counts(spark.range(3).withColumnRenamed("id", "node"), rows)
    assert [tuple(r) for r in out.collect()] == [(3, 2, 1)]
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_advisories_that_name_the_same_are_counted_once(spark):
    adv = spark.range(300).repartition(3).selectExpr("IF(id = 7, null, id) AS id", "'l' AS library", "1 AS low", "2 AS high", "array('a', 'b') AS props")
    dep, reach = spark.range(1).selectExpr("'l' AS library", "1 AS version"), spark.range(200).toDF("node")
    defs = spark.range(300).repartition(3).selectExpr("'l' AS library", "explode(array('a', 'b')) AS prop", "id AS fn")
    n, out = shuffled(spark, lambda: matching.alarms(adv, dep, defs, reach).collect())
    assert len(out) == 300 and {r.functions for r in out} == {200} and sum(r.id is None for r in out) == 1
    assert n < 10_000


def test_edges_are_judged_in_one_join_by_source(spark):
    """What is known of an edge's source meets it with the static targets; copies of an observation and known edges without any target stay."""
    rows = [("e1", "s", "f", "t", "../g", "1", False), ("e2", "s", "f", "t", "../g", "2", True), ("e2", "s", "f", "t", "../g", "2", True), ("e3", "n", "f", "t", "g", "9", False), ("e4", None, "f", "t", "g", "9", False)]
    observed = spark.createDataFrame(rows, "edge string, source string, source_file string, target string, target_file string, lines string, is_load boolean")
    static = spark.createDataFrame([("s", "function", "g", "1", None), ("s", "module", "h", None, None)], "source string, kind string, file string, lines string, place string")
    none = lambda schema: spark.createDataFrame([], schema)
    rules = soundness.Rules(
        unsound=spark.createDataFrame([("s", "t")], "source string, target string"), absent=spark.createDataFrame([("n",), ("s",)], "source string"), moved=none("target string, lines string"),
        wrong_loads=none("target string, file string"), alike=none("lines string, file string, place string"),
    )
    out = soundness.judged(observed, static, rules)
    got = sorted((r["edge"], r["class"], r.absent) for r in out.collect())
    assert got == [("e1", "unexpectedly_sound", True), ("e2", "known_unsound", True), ("e2", "known_unsound", True), ("e3", "expected_missing_source", True), ("e4", "missing_source", False)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Join \w+, .*\(edge#", plan)) == 0 and len(re.findall(r"Join \w+, \(source#\d+ = source#\d+\)", plan)) == 1


def test_traces_deal_the_first_edges_once(spark, monkeypatch):
    monkeypatch.setattr(session, "DEAL", 10)
    edges = spark.range(1, 300).selectExpr("id - 1 AS src", "id AS dst", "id AS ord")
    out = graph.traces(edges, spark.createDataFrame([(299,), (2,), (2,)], "node long"), 10)
    got = sorted(tuple(r) for r in out.collect())
    assert got == sorted([(299, k, 299 - k) for k in range(11)] + 2 * [(2, k, 2 - k) for k in range(3)])
    made = []
    monkeypatch.setattr(graph, "dealt", lambda df, key: made.append(key) or session.dealt(df, key))
    graph.traces(edges, spark.createDataFrame([(2,)], "node long"), 2)
    assert made == ["dst"]


def test_patterns_are_asked_at_once(spark):
    """Paths are made once, however many patterns there are; a path of two rows counts once."""
    rows = [("i", "import", None, "m1", True), ("p", "prop", "i", "bind", None), ("c", "call", "p", "", None), ("c", "call", "p", "", None), ("d", "call", "i", "", None)]
    made = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: made.add(1) or x)
    paths_ = spark.createDataFrame(rows, "ap string, kind string, on string, name string, default boolean").repartition(1).withColumn("name", seen.asNondeterministic()("name"))
    args = spark.createDataFrame([("c", 0)], "ap string, pos int")
    texts = ["import m*", "importD m1", "read <m1>.bind", "readO <m1>.bind", "call <m1>", "call {<m2>,<m1>.bind} [1,1]", "call <m1>.bind [2,2]", "call <m1>"]
    out = sorted(map(tuple, pattern_match.matches(paths_, args, texts).collect()))
    assert out == sorted([("import m*", "i"), ("importD m1", "i"), ("read <m1>.bind", "p"), ("call <m1>", "d"), ("call {<m2>,<m1>.bind} [1,1]", "c")])
    assert made.value == len(rows)


def shared_files(spark):
    """Folders in the shared one that hold files."""
    at = session.shared_dir(spark)
    return {os.path.relpath(d, at).split("/")[0] for d, _, files in os.walk(at) if files}


def settings(spark):
    return [spark.conf.get(f"spark.sql.{k}") for k in ("autoBroadcastJoinThreshold", "classic.shuffleDependency.fileCleanup.enabled")]


def test_the_solver_broadcasts_little_and_keeps_only_what_is_known(spark, monkeypatch):
    """Within the rounds large files are not broadcast and shuffles are removed; what stays is the solution's own tables, no checkpoints."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    own, during = settings(spark), []
    monkeypatch.setattr(solver, "fixpoint", lambda *a, **k: during.append(settings(spark)) or fixpoint(*a, **k))
    before = shared_files(spark)
    out = solver.solve(solver_facts(spark, SF))
    assert during == [[str(session.BROADCAST), "true"]] and settings(spark) == own
    read = {re.search("callweave-[0-9a-f]+", f)[0] for df in out.values() for f in df.inputFiles()}
    left = shared_files(spark) - before
    assert read <= left and len(left - read) <= 1 and not any(x.startswith("rdd") for x in left), left - read  # `live` is of the rounds


def test_paths_keep_only_their_levels(spark):
    before = shared_files(spark)
    out = construct.keyed(program(spark, SF)["paths"])
    read = {re.search("callweave-[0-9a-f]+", f)[0] for f in out.inputFiles()}
    assert shared_files(spark) - before == read and out.count() > 0


def test_what_a_scan_holds_is_compressed(spark):
    """Advisories that are held are tables, not checkpoints of raw rows."""
    before = shared_files(spark)
    adv = spark.createDataFrame([(1, "l", "1", "2", "call <l>"), (None, "l", "1", "2", "call <l>")], "id long, library string, low string, high string, pattern string")
    dep, returns = spark.createDataFrame([("l", "1.5.0")], "library string, version string"), spark.createDataFrame([], "fn long, returned long")
    defs = spark.createDataFrame([("l", None, 7)], "library string, prop string, fn long")
    out = scan.hits(adv, dep, defs, returns, spark.createDataFrame([(7,)], "node long"))
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "l", 7), (None, "l", 7)]
    assert not any(x.startswith("rdd") or len(x) == 36 for x in shared_files(spark) - before)


class _State:
    """A run's state, held here."""

    def __init__(self):
        self.get, self.exists = (), False

    def update(self, value):
        self.get, self.exists = value, True


def test_runs_are_taken_without_steps_over_frames(monkeypatch):
    """A run of few events pays for no sorting, casting or joining of frames; missing values stay missing, what adds nothing gives no frame."""
    for name in ("sort_values", "astype", "where", "itertuples"):
        monkeypatch.setattr(pd.DataFrame, name, lambda *a, **k: 1 / 0)
    at = [pd.Timestamp("2024-01-01 00:00:03.000004"), None, pd.Timestamp("2024-01-01 00:00:01"), pd.Timestamp("2024-01-01 00:00:02")]
    rows = [("read", True, "m", "o", "a", "number", ""), ("read", True, "m", "o", "z", "string", ""), ("loaded", True, None, "m", None, "object", None), ("invoke", None, "m", None, None, None, None)]
    frame = pd.DataFrame([(t, k, *r) for k, (t, r) in enumerate(zip(at, rows, strict=True))], columns=["ts", "event_id", "hook", "client", "base", "object", "name", "type", "place"])
    state = _State()
    (out,) = live._shapes((7,), iter([frame[:2], frame[2:]]), state)
    assert out["path"].tolist() == [live.MAIN, "a", "z"] and out["value"].tolist() == ["object", "number", "string"]
    assert out["ts"].tolist()[:2] == [at[2], at[0]] and out["ts"].isna().tolist() == [False, False, True]
    assert set(out["stream"]) == {7} and out["event_id"].tolist() == [2, 0, 1]
    assert list(live._shapes((7,), iter([frame[3:]]), state)) == [] and state.get[0].endswith("false]")  # nobody is known to have called


def test_only_paths_that_others_lead_to_go_through_rounds(spark, monkeypatch):
    """Of what paths call by themselves, rounds look at what others lead to; calls are not joined to what they stand on."""
    at = (1, 0, 1, 9)
    rows = [(f"f{k}", "function", None, None, f"/f{k}.js", None, at) for k in range(50)] + [("b", "prop", "f3", "bind", "/a.js", None, at), ("c", "call", "b", None, "/a.js", None, at), ("d", "call", "c", None, "/a.js", None, at)]
    k = construct.keyed(spark.createDataFrame(rows, "ap string, kind string, on string, name string, file string, target string, place struct<sl:int,sc:int,el:int,ec:int>"))
    none = lambda schema: spark.createDataFrame([], schema)
    args = spark.createDataFrame([("d", 2, "y"), ("d", 2, "x"), ("d", 0, "z"), ("d", 0, "z"), ("d", 1, None)], "ap string, pos int, arg string")
    taken = []
    monkeypatch.setattr(construct, "fixpoint", lambda base, step: taken.append(base["callee"].count()) or fixpoint(base, step))
    callee = construct.callees(k, args, none("file string, path string, fn string"), none("file string, prop string, ap string"))
    assert taken == [1]
    key = {r.ap: r.node_key for r in k.collect()}
    assert sorted(map(tuple, callee.collect())) == sorted([(a, key[a]) for a in key] + [("c", key["f3"])])
    before = shared_files(spark)
    out = construct.seeds(spark.createDataFrame([("f0", "d"), ("f0", "d"), ("f1", "b")], "fn string, ap string"), k, args, callee)
    edge, read = f"{key['f0']} --{key['d']}:z;;x, y from /a.js:1:0:1:9", f"{key['f1']} --{key['b']}: from /a.js:1:0:1:9"
    assert sorted(map(tuple, out.collect())) == sorted([(edge, "d", key["c"], key["c"]), (edge, "d", key["f3"], key["c"]), (read, "b", "GETTER<bind>", "GETTER<bind>")])
    assert len(shared_files(spark) - before) == 1  # uses with their edges; what they are made from is gone


def test_large_rounds_take_one_relation_after_the_other(spark, monkeypatch):
    """What one relation shuffles is gone before the next begins, where rounds begin with many rows; the rows are the same."""
    import threading

    at_once, most, lock, keep = [], [], threading.Lock(), rounds.Known.keep

    def kept(self, derived):
        with lock:
            at_once.append(self)
            most.append(len(at_once))
        time.sleep(0.5)
        try:
            return keep(self, derived)
        finally:
            with lock:
                at_once.remove(self)

    monkeypatch.setattr(rounds.Known, "keep", kept)
    base = {"a": spark.range(3).toDF("x"), "b": spark.range(5, 7).toDF("x")}
    step = lambda every, new: {"a": new["b"].where("x < 12").select((F.col("x") + 1).alias("x")), "b": new["a"].where("x < 12").select((F.col("x") + 1).alias("x"))}
    got = []
    for together, n in ((10, 2), (0, 1)):
        monkeypatch.setattr(rounds, "TOGETHER", together)
        most.clear()
        got.append({k: sorted(r.x for r in df.collect()) for k, df in fixpoint(base, step, max_rounds=3).items()})
        assert max(most) == n
    assert got[0] == got[1] == {"a": [0, 1, 2, 3, 4, 6, 7, 8, 9], "b": [1, 2, 3, 4, 5, 6, 7, 8]}
