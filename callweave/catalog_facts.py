"""More queries with their SQL, for operators over program facts, recorded runs and names; the tables play parts as in catalog.

Within an order, its lines are calls, or access paths that stand on one another; an order's priority and status, a line's tax,
flag and status say what kind of thing it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callweave.catalog import EDGE, LOAD, QUERIES, REACH, RUNS, SEQ, SIZED, TREE, fn_id, fns, load_edges, part_edges, query, reach, run, sized, streamed, tree
from callweave.functions import names, text
from callweave.operators import events, graph, lookups, paths, solver, soundness
from callweave.session import table
from callweave.sources.files import graph_lines
from callweave.streaming import live

__all__ = ["QUERIES"]

IN_ORDER = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey"
LINES = f"line AS (SELECT l_orderkey || '-' || row_number() OVER ({IN_ORDER}) AS edge, row_number() OVER ({IN_ORDER}) AS n, lead(l_partkey) OVER ({IN_ORDER}) AS following, * FROM lineitem)"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    n = F.row_number().over(w)
    return table(spark, sf, "lineitem").select("*", n.alias("n"), F.concat_ws("-", "l_orderkey", n).alias("edge"), F.lead("l_partkey").over(w).alias("following"))


def of(kind: str, column: str):
    return F.concat(F.lit(kind), F.col(column).cast("string"))


# ---- solver


@query(f"""WITH RECURSIVE {LINES}, {EDGE}, given AS (SELECT src AS fn, min(dst) AS nx FROM edge GROUP BY src),
arg AS (SELECT DISTINCT l_partkey AS fn, following AS t FROM line WHERE l_returnflag = 'N' AND following IS NOT NULL),
own AS (SELECT p_partkey AS fn, p_size, nx FROM part LEFT JOIN given ON fn = p_partkey),
back AS (SELECT fn, nx AS t FROM own WHERE p_size < 20 AND nx IS NOT NULL UNION SELECT own.fn, t FROM own JOIN arg ON own.fn = arg.fn WHERE p_size >= 35
  UNION SELECT own.fn, t FROM own JOIN back ON own.nx = back.fn WHERE p_size BETWEEN 20 AND 34)
SELECT edge, 'f' || l_partkey AS target FROM line WHERE l_returnflag = 'N' UNION SELECT edge, 'f' || t FROM line JOIN back ON l_partkey = fn WHERE l_returnflag = 'A'
UNION SELECT edge, 'f' || t FROM line JOIN arg ON l_partkey = fn WHERE l_returnflag = 'R'
UNION SELECT edge || '-b-0', 'f' || l_suppkey FROM line JOIN part ON p_partkey = l_suppkey WHERE l_returnflag = 'A' AND l_tax = 0.08""")
def op_solve(spark, sf):
    return solver.solve(solver_facts(spark, sf))["edge_target"].select("edge", "target")


def solver_facts(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Parts are functions f: small ones give back the next one called after them, those of middle size what that one gives back, large ones their argument. Lines flagged N call a part with the next one, A what a part gives back, R its argument; A lines of the highest tax make a further call, of a built-in function with the part numbered as their supplier."""
    line, part = lines(spark, sf), table(spark, sf, "part")
    f, r, p = (of(kind, "p_partkey") for kind in "frp")
    given = part_edges(spark, sf).groupBy("src").agg(F.min("dst").alias("nx"))
    size, nx = F.col("p_size"), F.col("nx").cast("string")
    back = F.when(size < 20, F.concat(F.lit("f"), nx)).when(size < 35, F.concat(F.lit("r"), nx)).otherwise(p)
    returns = part.join(given, part.p_partkey == given.src, "left").select(f.alias("fn"), back.alias("ap")).where("ap IS NOT NULL")
    at = lambda flag, kind: line.where(F.col("l_returnflag") == flag).select("edge", of(kind, "l_partkey").alias("node"))
    called = at("N", "f")
    built = line.where("l_returnflag = 'A' AND l_tax = 0.08").withColumn("edge", F.concat("edge", F.lit("-b")))
    args = line.where("l_returnflag = 'N' AND following IS NOT NULL").select("edge", F.lit(0).alias("pos"), of("f", "following").alias("ap"))
    return {
        "resolved": part.select(f.alias("node")),
        "callee_of": part.select(F.explode(F.array(f, r, p)).alias("ap")).select("ap", F.col("ap").alias("node")),
        "returns": returns,
        "edge_arg": args.union(built.select("edge", F.lit(0), of("f", "l_suppkey"))),
        "call_node": part.select(r.alias("node"), f.alias("callee")),
        "param_node": part.select(p.alias("node"), f.alias("fn"), F.lit(0).alias("pos")),
        "value_node": spark.createDataFrame([], "node string, ap string"),
        "builtin_node": spark.createDataFrame([("forEach", 0)], "node string, place int"),
        "pending": at("A", "r").union(at("R", "p")).union(built.select("edge", F.lit("forEach"))),
        "edge_target": called.toDF("edge", "target"),
    }


# ---- access paths

STANDS = "CASE WHEN n = 1 THEN CASE WHEN l_tax < 0.02 THEN 'function' WHEN l_tax < 0.03 THEN 'unknown' ELSE 'import' END WHEN l_returnflag = 'A' THEN 'call' ELSE 'prop' END"
FILE = "CASE WHEN l_linestatus = 'O' THEN '/app/node_modules/lib' || l_suppkey || '/index.js' ELSE 'src/f' || l_suppkey || '.js' END"
MODULE = "CASE WHEN l_linestatus = 'O' THEN '/app/node_modules/lib' || l_suppkey ELSE 'f' || l_suppkey || '.js' END"
AIM = "CASE WHEN l_discount < 0.02 THEN 'BUILT_IN' ELSE '/app/node_modules/lib' || l_partkey || '/main.js' END"
PATHS = f"path AS (SELECT l_orderkey, n, edge AS ap, {STANDS} AS kind, {FILE} AS file, {MODULE} AS module, {AIM} AS aim, 'm' || l_partkey AS name, l_suppkey, n AS sl FROM line)"
LEAF = "CASE kind WHEN 'function' THEN 'FunctionCreation:' || file || ':1:0' WHEN 'unknown' THEN 'U' ELSE '<' || CASE aim WHEN 'BUILT_IN' THEN name ELSE aim END || '>' END"


def access_paths(spark: SparkSession, sf: str) -> DataFrame:
    place = F.struct(F.lit(1).alias("sl"), F.lit(0).alias("sc"), F.lit(1).alias("el"), F.lit(9).alias("ec"))
    on = F.when(F.col("n") > 1, F.concat_ws("-", "l_orderkey", F.col("n") - 1))
    return lines(spark, sf).select(F.col("edge").alias("ap"), F.expr(STANDS).alias("kind"), on.alias("on"), of("m", "l_partkey").alias("name"), F.expr(FILE).alias("file"), F.expr(AIM).alias("target"), place.alias("place"))


ROOTED = f"""{LINES}, {PATHS}, k AS (SELECT l_orderkey, n, ap, kind AS root, CASE kind WHEN 'import' THEN aim ELSE file END AS root_file, kind = 'import' AS start, false AS chain, '' AS exported, {LEAF} AS node_key FROM path WHERE n = 1
  UNION ALL SELECT p.l_orderkey, p.n, p.ap, root, root_file, false, kind = 'prop' AND (start OR chain), CASE WHEN kind = 'prop' AND (start OR chain) THEN CASE exported WHEN '' THEN name ELSE exported || '.' || name END ELSE '' END,
    CASE kind WHEN 'call' THEN node_key || '()' ELSE 'PROP<' || module || ':' || CASE WHEN (start OR chain) AND root_file <> 'BUILT_IN' THEN regexp_extract(root_file, '^(.*node_modules/[^/]+)', 1) || '...' ELSE '' END || name || '>' END
  FROM k JOIN path p ON p.l_orderkey = k.l_orderkey AND p.n = k.n + 1)"""


@query(f"WITH RECURSIVE {ROOTED} SELECT ap, root, root_file, chain, exported, node_key FROM k")
def op_node_keys(spark, sf):
    return paths.rooted(access_paths(spark, sf), paths.FROM_LIBRARY).select("ap", "root", "root_file", "chain", "exported", "node_key")


KIND = "CASE WHEN starts_with(root_file, '/app/node_modules/lib1') THEN 'ignored' WHEN starts_with(node_key, 'FunctionCreation') AND NOT suffix(node_key, '()') THEN 'resolved' WHEN node_key = 'U' THEN 'unknown' ELSE 'unresolved' END"


@query(f"WITH RECURSIVE {ROOTED} SELECT DISTINCT node_key, {KIND} AS node_kind FROM k WHERE root <> 'function' OR n = 1")
def op_node_kinds(spark, sf):
    k = paths.rooted(access_paths(spark, sf), paths.FROM_LIBRARY).where("root <> 'function' OR node_key LIKE 'FunctionCreation%:1:0'")
    known = k.where("node_key LIKE 'FunctionCreation%:1:0'")
    ignored = k.where("root_file LIKE '/app/node_modules/lib1%'").select(F.col("root_file").alias("module"))
    return paths.node_kinds(k.select("node_key", F.col("root_file").alias("module")), known, ignored).distinct()


@query(f"WITH RECURSIVE {LOAD}, walk AS (SELECT 'c' || c_custkey AS file, 0 AS depth FROM customer WHERE c_mktsegment = 'MACHINERY' UNION SELECT dst, depth + 1 FROM walk JOIN load ON file = src) SELECT file, min(depth) AS depth FROM walk GROUP BY file")
def op_demanded(spark, sf):
    d = load_edges(spark, sf)
    entries = table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select(of("c", "c_custkey").alias("file"))
    return paths.demanded(entries, d.select(F.col("src").alias("file"), F.col("dst").alias("import")), d.select(F.col("src").alias("file"), F.col("dst").alias("import"), F.col("dst").alias("target")))


# ---- soundness

TALLIED = f"""{LINES}, obs AS (SELECT edge, 'o' || l_orderkey AS source, 'src/o' || l_orderkey || '.js' AS source_file, 'p' || l_partkey AS target, '../lib/p' || l_partkey || '.js' AS target_file,
  CASE WHEN p_size = 1 THEN '7' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS lines, l_returnflag = 'R' AS is_load, p_size, l_tax, o_orderpriority = '1-URGENT' AS absent
  FROM line JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
st AS (SELECT 'o' || l_orderkey AS source, CASE WHEN l_tax = 0.08 THEN 'unresolved' WHEN l_returnflag = 'R' THEN 'module' ELSE 'function' END AS kind, '/x/lib/p' || l_partkey || CASE WHEN p_size = 2 THEN '' ELSE '.js' END AS file, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS lines
  FROM line JOIN part ON p_partkey = l_partkey WHERE l_discount >= 0.03),
un AS (SELECT DISTINCT source, target FROM obs WHERE l_tax = 0.07),
met AS (SELECT o.edge, bool_or(kind = 'unresolved') AS open, bool_or(CASE WHEN is_load THEN kind = 'module' AND (contains(st.file, regexp_replace(target_file, '^\\.\\./', '')) OR (p_size = 2 AND st.file = '/x/lib/' || target))
  ELSE kind = 'function' AND (st.lines = o.lines OR (o.lines = '9' AND st.lines = '10')) END) AS fits FROM obs o JOIN st USING (source) GROUP BY o.edge),
j AS (SELECT obs.*, met.open, met.fits, un.source IS NOT NULL AS unsound, contains(source_file, 'o77') OR contains(target_file, 'o77') AS skipped, contains(source_file, 'p55') OR contains(target_file, 'p55') AS ignored, contains(source_file, 'p3') OR contains(target_file, 'p3') AS excused
  FROM obs LEFT JOIN met USING (edge) LEFT JOIN un ON un.source = obs.source AND un.target = obs.target),
c AS (SELECT *, CASE WHEN skipped THEN 'skipped' WHEN ignored THEN 'ignored' WHEN fits IS NULL AND absent THEN 'expected_missing_source' WHEN fits IS NULL THEN 'missing_source' WHEN open THEN 'unresolved'
  WHEN fits AND unsound THEN 'unexpectedly_sound' WHEN fits THEN 'correct' WHEN unsound THEN 'known_unsound' WHEN is_load THEN 'missing_load' ELSE 'missing_call' END AS class FROM j)"""


def n_of(*kinds: str) -> str:
    return f"count(*) FILTER (class IN ({', '.join(repr(k) for k in kinds)}))"


@query(f"""WITH {TALLIED} SELECT count(*) FILTER (class <> 'skipped') AS tested, {n_of('ignored')} AS ignored, {n_of('unresolved')} AS unresolved, {n_of('correct', 'unexpectedly_sound')} AS correct, {n_of('unexpectedly_sound')} AS unexpectedly_sound,
{n_of('known_unsound')} AS known_unsound, {n_of('expected_missing_source')} AS expected_missing_source, count(*) FILTER (absent AND class NOT IN ('skipped', 'ignored', 'expected_missing_source')) AS present_though_absent,
{n_of('missing_source')} AS missing_source, {n_of('missing_load')} AS missing_load, {n_of('missing_call')} AS missing_call, count(*) FILTER (class IN ('missing_source', 'missing_call') AND NOT excused) AS missing_unexcused FROM c""")
def op_soundness_tallies(spark, sf):
    return soundness.tallies(*tallied(spark, sf))


@query(f"WITH {TALLIED} SELECT edge, class, excused, absent FROM c")
def op_soundness_judged(spark, sf):
    return soundness.judged(*tallied(spark, sf))


def tallied(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, soundness.Rules]:
    d = lines(spark, sf).join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    d = d.withColumns({"source": of("o", "l_orderkey"), "target": of("p", "l_partkey"), "at": F.col("l_quantity").cast("int").cast("string")})
    known = d.join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    wrap = lambda before, c, after: F.concat(F.lit(before), F.col(c).cast("string"), after)
    observed = known.select("edge", "source", wrap("src/o", "l_orderkey", F.lit(".js")).alias("source_file"), "target", wrap("../lib/p", "l_partkey", F.lit(".js")).alias("target_file"), F.col("at").alias("lines"), (F.col("l_returnflag") == "R").alias("is_load"))
    kind = F.when(F.col("l_tax") == 0.08, soundness.UNRESOLVED).when(F.col("l_returnflag") == "R", soundness.MODULE).otherwise(soundness.FUNCTION)
    file = wrap("/x/lib/p", "l_partkey", F.when(F.col("p_size") == 2, "").otherwise(".js"))
    static = d.where("l_discount >= 0.03").select("source", kind.alias("kind"), file.alias("file"), F.col("at").alias("lines"), F.when(F.col("at") == "10", "10:0").alias("place"))
    part = table(spark, sf, "part")
    rules = soundness.Rules(
        unsound=known.where("l_tax = 0.07").select("source", "target"),
        absent=table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(of("o", "o_orderkey").alias("source")),
        moved=part.where("p_size = 1").select(of("p", "p_partkey").alias("target"), F.lit("7").alias("lines")),
        wrong_loads=part.where("p_size = 2").select(of("p", "p_partkey").alias("target"), of("/x/lib/p", "p_partkey").alias("file")),
        alike=static.where("place IS NOT NULL").select(F.lit("9").alias("lines"), "file", "place").distinct(),
        skipped=("o77",), ignored=("p55",), excused=("p3",),
    )
    return observed, static, rules


# ---- reads, calls, usages


@query(f"""WITH {SIZED}, r AS (SELECT DISTINCT p_type || p_brand AS read, 'prefix' AS kind, left(prop, length(prop) - 1 - p_size % 2) AS t FROM word
  UNION SELECT DISTINCT p_type || p_brand, 'suffix', right(prop, 3 + p_size % 2) FROM word)
SELECT DISTINCT read, p_partkey AS ap FROM r JOIN word ON CASE kind WHEN 'prefix' THEN starts_with(prop, t) ELSE suffix(prop, t) END""")
def op_wild_reads(spark, sf):
    d, n = sized(spark, sf), F.col("p_size") % 2
    cuts = (("prefix", F.left("prop", F.length("prop") - 1 - n)), ("suffix", F.right("prop", 3 + n)))
    reads = [d.select(F.concat("p_type", "p_brand").alias("read"), F.lit(kind).alias("kind"), cut.alias("text")) for kind, cut in cuts]
    return lookups.read_by_pattern(reads[0].union(reads[1]).distinct(), d.select("prop", F.col("p_partkey").alias("ap")).distinct())


@query("SELECT DISTINCT l_orderkey AS edge, l_suppkey AS ap FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'N' AND l_linenumber = 1")
def op_constructor(spark, sf):
    module = F.when(F.col("l_linestatus") == "O", names.BUILT_IN).otherwise("lib")
    calls = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("edge"), module.alias("module"), F.when(F.col("l_returnflag") == "N", "Promise").otherwise("JSON").alias("name"), (F.col("l_linenumber") - 1).alias("pos"), F.col("l_suppkey").alias("ap"))
    return lookups.constructed(calls)


USAGES = f"""{TREE}, {LINES}, u AS (SELECT 's' || l_suppkey AS package, CAST(l_linenumber AS VARCHAR) || '.js' AS file, p_type || '.' || p_brand AS usage FROM line JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'R'),
w AS (SELECT 's' || l_suppkey AS package, CAST(l_linenumber AS VARCHAR) || '.js' AS file FROM lineitem), ky AS (SELECT 's' || s_suppkey AS package, 'n' || s_nationkey AS key, '1.js' AS file, s_suppkey AS line FROM supplier),
us AS (SELECT DISTINCT package, key, usage FROM ky JOIN (SELECT DISTINCT package, usage FROM u) USING (package) UNION SELECT ky.package, key, ky.file || ':' || line || ':0' FROM ky JOIN w ON w.package = ky.package AND w.file <> ky.file)"""


def usage_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    calls = d.select(of("s", "l_suppkey").alias("package"), F.concat(F.col("l_linenumber").cast("string"), F.lit(".js")).alias("file"), F.concat_ws(".", "p_type", "p_brand").alias("path"), (F.col("l_returnflag") == "R").alias("is_require"))
    keys = table(spark, sf, "supplier").select(of("s", "s_suppkey").alias("package"), of("n", "s_nationkey").alias("key"), F.lit("1.js").alias("file"), F.col("s_suppkey").alias("line"), F.lit(0).alias("column"))
    return lookups.usages(calls, keys)


@query(f"WITH {USAGES} SELECT package, key, usage FROM us")
def op_usages(spark, sf):
    return usage_rows(spark, sf)


@query(f"""WITH {USAGES} SELECT key, '["' || array_to_string(list_sort(list(DISTINCT usage)), '","') || '"]' AS usages FROM us GROUP BY key""")
def op_usage_summary(spark, sf):
    return lookups.usage_summary(usage_rows(spark, sf))


# ---- graphs as text and in numbers

SIZES = "CASE WHEN p_size < 10 THEN 'resolved' WHEN p_size < 20 THEN 'ignored' WHEN p_size < 30 THEN 'unknown' ELSE 'unresolved' END"


@query(f"""WITH {EDGE} SELECT 0 AS part, '  "f' || p_partkey || '"' || CASE WHEN p_size < 10 THEN '' WHEN p_size < 20 THEN ' [ color = "palegreen", style = "filled" ]' ELSE ' [ color = "lightblue", style = "filled" ]' END || ';' AS line FROM part
UNION ALL SELECT 1, '  "f' || src || '" -> "f' || dst || '" [ label = "PROP<' || src || '>" ];' FROM edge""")
def op_graph_text(spark, sf):
    nodes = table(spark, sf, "part").select(of("f", "p_partkey").alias("node"), F.expr(SIZES).alias("node_kind"))
    edges = part_edges(spark, sf).select(of("f", "src").alias("source"), of("f", "dst").alias("target"), F.concat(F.lit("PROP<"), F.col("src").cast("string"), F.lit(">")).alias("label"))
    return graph_lines(nodes, edges)


@query(f"WITH {LINES} SELECT (SELECT count(DISTINCT p_partkey) FROM part) AS nodes, count(DISTINCT edge) AS edges, count(DISTINCT (l_partkey, following)) AS pairs FROM line WHERE following IS NOT NULL")
def op_graph_counts(spark, sf):
    targets = lines(spark, sf).where("following IS NOT NULL").select("edge", F.col("l_partkey").alias("source"), F.col("following").alias("target"))
    return graph.graph_counts(table(spark, sf, "part").select(F.col("p_partkey").alias("node")), targets)


@query(f"WITH RECURSIVE {REACH} SELECT count(DISTINCT module) AS modules FROM fn WHERE module LIKE 'Brand#1%' AND node IN (SELECT node FROM reach)")
def op_modules_reached(spark, sf):
    return graph.modules_reached(fns(spark, sf).join(reach(spark, sf), "node", "left_semi"), "Brand#1")


#: Paths of a line belong to the function that the line is; the path at their bottom says what is imported.
@query(f"""WITH RECURSIVE {REACH}, {ROOTED.replace("l_suppkey, n AS sl", "l_suppkey, l_partkey, l_quantity").replace("(SELECT l_orderkey, n, ap, kind AS root", "(SELECT l_orderkey, n, ap, l_partkey, l_quantity, kind AS root").replace("p.n, p.ap, root", "p.n, p.ap, p.l_partkey, p.l_quantity, root")},
used AS (SELECT l_partkey * 100 + CAST(l_quantity AS BIGINT) AS node, root_file FROM k WHERE root = 'import'),
home AS (SELECT module, min(node) AS main FROM fn GROUP BY module)
SELECT DISTINCT root_file AS module FROM used WHERE node IN (SELECT node FROM reach) OR node IN (SELECT main FROM home JOIN fn USING (module) WHERE node IN (SELECT node FROM reach))""")
def op_used_modules(spark, sf):
    f = fns(spark, sf)
    homes = f.join(f.groupBy("module").agg(F.min("node").alias("main")), "module").select("node", "main")
    usage = lines(spark, sf).select(fn_id().alias("fn"), F.col("edge").alias("ap"))
    return graph.used_modules(reach(spark, sf), homes, usage, paths.rooted(access_paths(spark, sf), paths.FROM_LIBRARY))


@query(f"WITH RECURSIVE {TREE}, top AS (SELECT 'r' || r_regionkey AS run, 'r' || r_regionkey AS node FROM region UNION ALL SELECT run, dst FROM top JOIN tree ON node = src) SELECT run, count(*) AS dependencies FROM top WHERE run <> node GROUP BY run")
def op_dependency_counts(spark, sf):
    below = graph.subtrees(tree(spark, sf)).where("module <> member AND module LIKE 'r%'")
    return graph.dependency_counts(below.select(F.col("module").alias("run"), F.col("module").alias("parent"), F.col("member").alias("child")))


@query(f"""WITH {LINES} SELECT DISTINCT relation, a, b FROM (SELECT 'edge' AS relation, edge AS a, 'f' || l_partkey AS b FROM line UNION ALL SELECT 'returns', 'f' || l_partkey, 'f' || following FROM line WHERE following IS NOT NULL UNION ALL SELECT 'main', 'o' || l_orderkey, 'open' FROM line WHERE l_linestatus = 'O')""")
def op_joined_graphs(spark, sf):
    def one(d: DataFrame) -> dict[str, DataFrame]:
        return {"edge": d.select(F.col("edge").alias("a"), of("f", "l_partkey").alias("b")), "returns": d.where("following IS NOT NULL").select(of("f", "l_partkey").alias("a"), of("f", "following").alias("b"))}

    d = lines(spark, sf)
    main = {"main": d.where("l_linestatus = 'O'").select(of("o", "l_orderkey").alias("a"), F.lit("open").alias("b"))}
    every = graph.joined_graphs(one(d.where("l_linestatus = 'O'")) | main, one(d.where("l_returnflag <> 'R'")), one(d.where("l_linestatus <> 'O'")))
    tagged = [rows.select(F.lit(name).alias("relation"), "a", "b") for name, rows in every.items()]
    return tagged[0].union(tagged[1]).union(tagged[2])


@query("SELECT DISTINCT p_brand || p_type AS module FROM part WHERE p_size % 5 = 2")
def op_no_functions(spark, sf):
    p = table(spark, sf, "part").withColumn("module", F.concat("p_brand", "p_type"))
    main = F.element_at(F.array(F.lit('{"file": "a.js"}'), F.lit('"object"'), F.lit('"string"'), F.lit(None).cast("string"), F.lit("null")), F.col("p_size") % 5 + 1)
    return graph.no_functions(p.select("module"), p.select("module", main.alias("main")))


# ---- recorded runs

PLACE = "CASE k % 6 WHEN 0 THEN '(graceful-fs/g.js:1:1:2:2)' WHEN 1 THEN '(*native)' ELSE '(f' || k || '.js:1:1:2:2)' END"
HOOK = "CASE kind WHEN 'call' THEN 'invoke' WHEN 'enter' THEN 'function' WHEN 'clear' THEN 'builtin' WHEN 'load' THEN 'require' ELSE 'none' END"


@query(f"""WITH {RUNS}, h AS (SELECT stream, ts, event_id, {HOOK} AS hook, {PLACE} AS place, start IS NULL OR k % 2 = 0 AS takes FROM run),
e AS (SELECT *, CASE WHEN hook = 'invoke' AND NOT contains(place, 'graceful-fs') THEN 'call' WHEN hook = 'builtin' AND NOT takes THEN 'clear' WHEN hook = 'function' AND place = '(*native)' THEN 'clear'
  WHEN hook = 'function' AND NOT contains(place, 'graceful-fs') THEN 'enter' WHEN hook = 'require' THEN 'load' ELSE 'none' END AS kind FROM (SELECT *, CAST(regexp_extract(place, '([0-9]+)', 1) AS VARCHAR) AS x FROM h)),
c AS (SELECT *, last_value(CASE WHEN kind = 'call' THEN place WHEN kind <> 'none' THEN '' END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS caller FROM e)
SELECT DISTINCT stream, caller AS source, place AS target, kind = 'load' AS is_load FROM c WHERE caller <> '' AND (kind = 'load' OR (kind = 'enter' AND caller <> '(*native)'))""")
def op_recorded_edges(spark, sf):
    hooks = run(spark, sf).withColumns({"hook": F.expr(HOOK), "place": F.expr(PLACE)})
    return events.recorded_edges(hooks.select("stream", *SEQ, "hook", "place", (F.col("k") % 2 == 0).alias("takes_function")), *SEQ)


LOADED_NAMES = "CASE k % 6 WHEN 0 THEN 'fs' WHEN 1 THEN 'node:path' WHEN 2 THEN 'fs/promises' WHEN 3 THEN 'nodejs/x' ELSE 'lib' || k END"


@query(f"WITH {RUNS}, o AS (SELECT *, {LOADED_NAMES} AS name, bool_or(start) OVER (PARTITION BY stream ORDER BY ts, event_id) AS is_on FROM run) SELECT stream, event_id, name AS key FROM o WHERE is_on AND kind = 'load' AND k % 6 > 3 AND k >= 50")
def op_builtin_loads(spark, sf):
    d = run(spark, sf).withColumn("key", F.expr(LOADED_NAMES))
    allowed = spark.range(50).select(F.concat(F.lit("lib"), F.col("id").cast("string")).alias("key"))
    return events.illegal_loads(d, allowed, F.col("start"), *SEQ, builtin=names.is_builtin_module(F.col("key"))).select("stream", "event_id", "key")


@query("""SELECT source_file, target_file, source_lines || '->' || target_lines AS edge FROM (SELECT l_suppkey AS source_file, l_partkey AS target_file, l_linenumber || ':' || l_linenumber AS source_lines, l_partkey || ':' || l_partkey AS target_lines,
  row_number() OVER (PARTITION BY l_linenumber, l_partkey ORDER BY l_linestatus, l_orderkey, l_suppkey) AS n FROM lineitem) WHERE n = 1""")
def op_combined_edges(spark, sf):
    twice = lambda c: F.concat_ws(":", c, c)
    d = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("input"), F.struct("l_orderkey", "l_suppkey").alias("seq"), F.col("l_suppkey").alias("source_file"), F.col("l_partkey").alias("target_file"), twice("l_linenumber").alias("source_lines"), twice("l_partkey").alias("target_lines"))
    return events.combined(d).select("source_file", "target_file", names.dynamic_edge(F.col("source_lines"), F.col("target_lines")).alias("edge"))


SHAPES = f"""{RUNS}, h AS (SELECT *, bool_or(start) OVER (PARTITION BY stream ORDER BY ts, event_id) AS is_on FROM run),
g AS (SELECT *, last_value(CASE WHEN kind = 'call' AND is_on THEN true WHEN kind = 'clear' THEN false END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS entering,
  bool_or(kind = 'enter' AND k % 3 = 0 AND is_on) OVER (PARTITION BY stream, k ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM h),
a AS (SELECT stream, ts, event_id, 'MAIN_MODULE' AS path, 'object' AS value FROM g WHERE start UNION ALL SELECT stream, ts, event_id, 'x' || k, CASE k % 3 WHEN 1 THEN 'number' ELSE 'string' END FROM g WHERE kind = 'enter' AND is_on AND k % 3 <> 0
  UNION ALL SELECT stream, ts, event_id, 'x' || k, '(g' || k || '.js)' FROM g WHERE kind = 'clear' AND entering AND known)"""


@query(f"WITH {SHAPES} SELECT stream, path, arg_max(value, {{'ts': ts, 'id': event_id}}) AS value FROM a GROUP BY stream, path")
def op_api_shape(spark, sf):
    """Signups load the library, views read a property, clicks call into it, errors enter a function."""
    d = streamed(spark, sf)
    hook = F.when(F.col("start"), "loaded").when(F.col("kind") == "enter", "read").when(F.col("kind") == "call", "invoke").when(F.col("kind") == "clear", "function").otherwise("none")
    kind = F.when(F.col("start"), "object").otherwise(F.element_at(F.array(F.lit("function"), F.lit("number"), F.lit("string")), (F.col("k") % 3 + 1).cast("int")))
    what = F.when(F.col("start"), "module").when(F.col("kind") != "call", of("g", "k"))
    name, place = F.when(~F.col("start"), of("x", "k")), F.concat(F.lit("(g"), F.col("k").cast("string"), F.lit(".js)"))
    hooks = d.select("stream", "ts", "event_id", hook.alias("hook"), F.lit(True).alias("client"), F.lit("module").alias("base"), what.alias("object"), name.alias("name"), kind.alias("type"), place.alias("place"))
    return live.package_model(live.drained(live.shapes(hooks)))


# ---- names


@query("""SELECT doc_id, CASE source[1:1] WHEN 'b' THEN '@' ELSE '' END || source || '/x' AS name, lang || '@' || n_chars AS version, CASE source[1:1] WHEN 'b' THEN '@' ELSE '' END || source || '/x@' || lang || '@' || n_chars AS whole, source || '-x' AS packed FROM documents""")
def op_package_names(spark, sf):
    at = F.when(F.left("source", F.lit(1)) == "b", "@").otherwise("")
    d = table(spark, sf, "documents").withColumn("p", names.package(F.concat(at, "source", F.lit("/x@"), "lang", F.lit("@"), F.col("n_chars").cast("string"))))
    name, version = F.col("p.name"), F.col("p.version")
    return d.select("doc_id", name.alias("name"), version.alias("version"), names.package_string(name, version).alias("whole"), names.packed_name(name).alias("packed"))


@query(r"""SELECT page_id, regexp_extract(path, '([^/]*)/*$', 1) AS base, regexp_replace(path, '/+[^/]*/*$', '') AS folder, path AS clean, CASE WHEN contains(path, 'node_modules') THEN regexp_extract(path, '^(.*node_modules/[^/]+)', 1) ELSE 'main' END AS module
FROM (SELECT page_id, replace(regexp_extract(url, '^[a-z]+:/(/[^?#]*)', 1), '/en/', '/node_modules/') AS path FROM pages)""")
def op_paths(spark, sf):
    path = F.replace(F.regexp_extract("url", r"^[a-z]+:/(/[^?#]*)", 1), F.lit("/en/"), F.lit("/node_modules/"))
    d = table(spark, sf, "pages").select("page_id", path.alias("path"))
    messy = names.normalized(F.concat(F.lit("/a/.././"), F.replace("path", F.lit("/"), F.lit("//"))))
    return d.select("page_id", names.basename(F.col("path")).alias("base"), names.dirname(F.col("path")).alias("folder"), messy.alias("clean"), names.module_or_main(F.col("path"), F.lit("main")).alias("module"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'number' WHEN 'view' THEN 'string' WHEN 'error' THEN 'boolean' WHEN 'purchase' THEN 'undefined' ELSE 'object' END AS type FROM events""")
def op_value_type(spark, sf):
    t = F.col("event_type")
    json = F.when(t == "click", F.col("value").cast("string")).when(t == "view", F.concat(F.lit('"'), t, F.lit('"'))).when(t == "error", "true").when(t != "purchase", F.col("props"))
    return table(spark, sf, "events").select("event_id", names.value_type(json).alias("type"))


@query("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'Promise' WHEN 1 THEN 'global' WHEN 2 THEN 'global' WHEN 3 THEN 'parseFloat' WHEN 4 THEN 'JSON' END AS import FROM part")
def op_globals(spark, sf):
    name = F.element_at(F.array(*[F.lit(x) for x in ("Promise", "window", "globalThis", "parseInt", "JSON", "nothing")]), F.col("p_size") % 6 + 1)
    return table(spark, sf, "part").select("p_partkey", names.builtin_global(name).alias("import"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 90 >= 61 THEN event_id % 90 - 61 ELSE event_id % 90 END AS sc, CASE WHEN event_id % 3 = 0 AND event_id % 90 >= 61 THEN event_id % 90 - 61 ELSE event_id % 90 END + 4 AS ec FROM events""")
def op_recorded_place(spark, sf):
    e = F.col("event_id")
    raw = F.format_string("(f%d:%d:%d:%d:%d)", "user_id", e % 3 + 1, e % 90 + 1, e % 3 + 1, e % 90 + 5)
    d = table(spark, sf, "events").select("event_id", text.instrumented_location(raw).alias("loc"))
    return d.select("event_id", F.col("loc.sc").cast("long").alias("sc"), F.col("loc.ec").cast("long").alias("ec"))
