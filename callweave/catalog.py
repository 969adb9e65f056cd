"""Queries over the supplied tables, one for each operator, with the SQL that gives the same rows.

The tables hold no programs, so that each plays a part: within an order the parts of its lines call one another. Parts are
functions, the words of their names properties. For what is reached, a part is a function for each quantity it is sold in, those of
parts of size 1 are entry points, ten quantities of a part a module, half of them a package, brand and type a library.
events of a user are a run's calls (click), entries (view), clearings (error) and loads (purchase); regions, nations, suppliers
and customers are a dependency tree; customers load orders, and these parts. Every table takes part whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callweave.functions import globs, text
from callweave.functions.names import BUILT_IN
from callweave.operators import events, graph, lookups, matching, scan, solver
from callweave.plans.fixpoint import reached
from callweave.session import table
from callweave.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# ---- the parts that tables play


def part_edges(spark: SparkSession, sf: str, which: str = "true") -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    d = table(spark, sf, "lineitem").where(which)
    return d.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("dst IS NOT NULL").distinct()


def fn_id() -> Column:
    return F.col("l_partkey") * 100 + F.col("l_quantity").cast("long")


def fns(spark: SparkSession, sf: str, which: str = "true") -> DataFrame:
    """node, with its part's columns, module, package and library."""
    q = (F.col("l_quantity") / 10).cast("int").cast("string")
    half = F.when(F.col("l_quantity") > 25, "b").otherwise("a")
    d = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).where(which)
    names = {"node": fn_id(), "module": F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string"), q), "package": F.concat_ws("/", F.col("p_partkey").cast("string"), half), "library": F.concat_ws("-", "p_type", "p_brand")}
    return d.select(*[c.alias(n) for n, c in names.items()], "p_partkey", "p_size", "p_name").distinct()


def fn_edges(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf, "lineitem").select(fn_id().alias("src"), F.lead(fn_id()).over(w).alias("dst")).where("dst IS NOT NULL").distinct()


def reach(spark: SparkSession, sf: str, which: str = "p_size = 1") -> DataFrame:
    return reached(fn_edges(spark, sf), fns(spark, sf, which).select("node")).select("node")


def named(kind: str, column: str) -> Column:
    return F.concat(F.lit(kind), F.col(column).cast("string"))


def load_edges(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(named("c", "o_custkey").alias("src"), named("o", "o_orderkey").alias("dst"))
    return orders.union(table(spark, sf, "lineitem").select(named("o", "l_orderkey"), named("p", "l_partkey"))).distinct()


def loaders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(named("c", "c_custkey").alias("node"))


def words_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("*", F.explode(F.split("p_name", " ")).alias("prop"))


def sized(spark: SparkSession, sf: str) -> DataFrame:
    return words_of(spark, sf).withColumn("prop", F.concat("prop", F.col("p_size").cast("string")))


def tree(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    nations = table(spark, sf, "nation").select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
    return nations.union(table(spark, sf, "supplier").select(name("n", "s_nationkey").alias("src"), name("s", "s_suppkey").alias("dst")))


def runs(rows: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", events.CALL).when(F.col("event_type") == "view", events.ENTER).when(F.col("event_type") == "error", events.CLEAR).when(F.col("event_type") == "purchase", events.LOAD).otherwise("none")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    return rows.select(F.col("user_id").alias("stream"), "ts", "event_id", kind.alias("kind"), F.col("event_id").alias("key"), k.alias("k"), (F.col("event_type") == "signup").alias("start"))


EDGE = """edge AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst
  FROM lineitem) WHERE dst IS NOT NULL)"""
FNS = """fn AS (SELECT DISTINCT l_partkey * 100 + CAST(l_quantity AS BIGINT) AS node, p_brand || '/' || p_partkey || '/' || CAST(floor(l_quantity / 10) AS INTEGER) AS module,
  p_partkey || '/' || CASE WHEN l_quantity > 25 THEN 'b' ELSE 'a' END AS package, p_type || '-' || p_brand AS library, p_partkey, p_size, p_name
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""
CALLED = """call AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey * 100 + CAST(l_quantity AS BIGINT) AS src, lead(l_partkey * 100 + CAST(l_quantity AS BIGINT))
  OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL)"""
REACH = f"{FNS}, {CALLED}, reach AS (SELECT node FROM fn WHERE p_size = 1 UNION SELECT dst FROM reach JOIN call ON node = src)"
LOAD = "load AS (SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem)"
LOADED = "walk AS (SELECT 'c' || c_custkey AS node, 0 AS depth FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT dst, depth + 1 FROM walk JOIN load ON node = src)"
WORDS = "word AS (SELECT *, unnest(string_split(p_name, ' ')) AS prop FROM part)"
#: Words with the part's size behind them: names of which few are alike.
SIZED = "word AS (SELECT *, unnest(string_split(p_name, ' ')) || p_size AS prop FROM part)"
TREE = "tree AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"
RUNS = """run AS (SELECT user_id AS stream, ts, event_id, event_id AS key, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_type = 'signup' AS start,
  CASE event_type WHEN 'click' THEN 'call' WHEN 'view' THEN 'enter' WHEN 'error' THEN 'clear' WHEN 'purchase' THEN 'load' ELSE 'none' END AS kind FROM events)"""
CALLER = """c AS (SELECT *, last_value(CASE WHEN kind = 'call' THEN key WHEN kind <> 'none' THEN -1 END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS caller FROM run)"""

# ---- graphs


@query(f"WITH RECURSIVE {REACH} SELECT node FROM reach")
def op_reach(spark, sf):
    return reach(spark, sf)


@query(f"WITH RECURSIVE {REACH} SELECT src, dst FROM call WHERE src IN (SELECT node FROM reach)")
def op_reach_edges(spark, sf):
    return graph.induced(fn_edges(spark, sf), reach(spark, sf))


@query(f"WITH RECURSIVE {REACH.replace('p_size = 1', 'p_size <= 5')} SELECT node FROM reach")
def op_reach_all_usages(spark, sf):
    return reach(spark, sf, "p_size <= 5")


@query(f"WITH RECURSIVE {LOAD}, {LOADED} SELECT node, min(depth) AS depth FROM walk GROUP BY node")
def op_transitive_load(spark, sf):
    return reached(load_edges(spark, sf), loaders(spark, sf))


@query(f"WITH RECURSIVE {LOAD}, {LOADED} SELECT node FROM (SELECT 'o' || o_orderkey AS node FROM orders UNION SELECT 'p' || p_partkey FROM part) WHERE node NOT IN (SELECT node FROM walk)")
def op_redundant(spark, sf):
    nodes = table(spark, sf, "orders").select(named("o", "o_orderkey").alias("node")).union(table(spark, sf, "part").select(named("p", "p_partkey")))
    return graph.unreached(nodes.distinct(), load_edges(spark, sf), loaders(spark, sf))


@query(f"WITH RECURSIVE {TREE}, c AS (SELECT src AS module, src AS member FROM tree UNION SELECT dst, dst FROM tree UNION SELECT module, dst FROM c JOIN tree ON member = src) SELECT module, member FROM c")
def op_closure_subtree(spark, sf):
    return graph.subtrees(tree(spark, sf))


@query(f"WITH {TREE} SELECT src AS module, src AS member FROM tree UNION SELECT dst, dst FROM tree UNION SELECT src, dst FROM tree UNION SELECT dst, src FROM tree")
def op_distance1(spark, sf):
    return graph.neighbours(tree(spark, sf))


@query(f"""WITH RECURSIVE {TREE}, below AS (SELECT src, dst FROM tree UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
fn AS (SELECT 's' || s_suppkey AS node FROM supplier UNION SELECT 'c' || c_custkey FROM customer),
rho AS (SELECT node, node AS target FROM fn UNION SELECT src, target FROM below JOIN rho ON dst = node) SELECT node, target FROM rho""")
def op_points_to(spark, sf):
    customers = table(spark, sf, "customer").select(named("n", "c_nationkey"), named("c", "c_custkey").alias("node"))
    resolved = table(spark, sf, "supplier").select(named("s", "s_suppkey").alias("node")).union(customers.select("node"))
    return solver.targets(tree(spark, sf).union(customers).toDF("node", "below"), resolved)


@query(f"""WITH {FNS}, {CALLED}, pred AS (SELECT dst, min(src) AS src FROM call GROUP BY dst), s0 AS (SELECT node AS target, 0 AS step, node FROM fn),
{", ".join(f"s{k} AS (SELECT target, {k} AS step, src AS node FROM s{k - 1} JOIN pred ON node = dst)" for k in range(1, 11))} {" UNION ALL ".join(f"SELECT target, step, node FROM s{k}" for k in range(11))}""")
def op_stack_trace(spark, sf):
    return graph.traces(fn_edges(spark, sf).withColumn("ord", F.col("src")), fns(spark, sf).select("node"))


@query(f"WITH {EDGE.replace('FROM lineitem)', "FROM lineitem WHERE l_linestatus = 'O')")}, {EDGE.replace('edge AS', 'other AS').replace('FROM lineitem)', "FROM lineitem WHERE l_linestatus <> 'O')")} SELECT src, dst FROM edge UNION SELECT src, dst FROM other")
def op_merge_graph(spark, sf):
    return graph.merged(part_edges(spark, sf, "l_linestatus = 'O'"), part_edges(spark, sf, "l_linestatus <> 'O'"))


@query("""WITH l AS (SELECT l_partkey AS key, min(l_suppkey) AS value FROM lineitem GROUP BY 1), r AS (SELECT l_partkey AS key, max(l_suppkey) AS value FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT coalesce(r.key, l.key) AS key, coalesce(r.value, l.value) AS value FROM l FULL JOIN r ON l.key = r.key""")
def op_joinmaps(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("key"), "l_suppkey", "l_returnflag")
    return graph.overridden(d.groupBy("key").agg(F.min("l_suppkey").alias("value")), d.where("l_returnflag = 'R'").groupBy("key").agg(F.max("l_suppkey").alias("value")))


@query("""WITH a AS (SELECT DISTINCT 'c' || o_custkey AS prop, 'o' || o_orderkey AS ap FROM orders), n AS (SELECT prop, count(*) AS n FROM a GROUP BY prop)
SELECT DISTINCT prop, CASE WHEN n > 10 THEN 'Unknown' ELSE ap END AS ap FROM a JOIN n USING (prop)""")
def op_alias_cap(spark, sf):
    return graph.capped(table(spark, sf, "orders").select(named("c", "o_custkey").alias("prop"), named("o", "o_orderkey").alias("ap")), 10)


@query(f"WITH RECURSIVE {REACH} SELECT count(DISTINCT node) AS functions, count(DISTINCT module) AS modules, count(DISTINCT package) - 1 AS packages FROM fn WHERE node IN (SELECT node FROM reach)")
def op_reach_metrics(spark, sf):
    return graph.metrics(fns(spark, sf).join(reach(spark, sf), "node", "left_semi"))


@query("SELECT count(*) AS pairs FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)")
def op_pairs(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count_distinct("l_suppkey", "l_partkey").alias("pairs"))


ARGS = "a AS (SELECT l_orderkey AS edge_id, l_linenumber AS pos, list_sort(list(DISTINCT l_partkey)) AS s FROM lineitem GROUP BY ALL), e AS (SELECT edge_id, list(s ORDER BY pos) AS args FROM a GROUP BY edge_id)"


def arguments(spark: SparkSession, sf: str) -> DataFrame:
    sets = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("edge_id"), F.col("l_linenumber").alias("pos")).agg(F.array_sort(F.collect_set("l_partkey")).alias("s"))
    return sets.groupBy("edge_id").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("a")).select("edge_id", F.col("a.s").alias("args"))


@query(f"WITH {ARGS} SELECT edge_id, array_to_string(list_transform(args, lambda x: array_to_string(x, ', ')), ';') AS args FROM e")
def op_args_string(spark, sf):
    strings = F.transform("args", lambda x: x.cast("array<string>"))
    return arguments(spark, sf).select("edge_id", lookups.args_string(strings).alias("args"))


@query(f"WITH {ARGS} SELECT edge_id || '-0' AS edge_id, CAST(0 AS BIGINT) AS n_args, CAST(NULL AS BIGINT) AS first FROM e UNION ALL SELECT edge_id || '-1', len(args) - 1, args[2][1] FROM e")
def op_edge_variants(spark, sf):
    e = arguments(spark, sf)
    both = graph.without_arguments(e).unionByName(graph.without_arguments(e, first_only=True))
    return both.select("edge_id", F.size("args").cast("long").alias("n_args"), F.get(F.get("args", F.lit(0)), F.lit(0)).alias("first"))


# ---- reads and writes


@query(f"WITH {WORDS} SELECT DISTINCT r.p_partkey AS read, w.p_partkey AS ap FROM word r JOIN word w ON r.p_brand = w.p_brand AND r.prop = w.prop")
def op_field_exact(spark, sf):
    d = words_of(spark, sf).select(F.col("p_partkey").alias("read"), F.col("p_brand").alias("module"), "prop").distinct()
    return lookups.fields(d, d.withColumnRenamed("read", "ap"))


@query(f"""WITH {SIZED}, pat AS (SELECT DISTINCT 'prefix' AS kind, left(prop, length(prop) - 1) AS t, p_type || p_brand AS ap FROM word UNION SELECT DISTINCT 'suffix', right(prop, 3), p_type || p_brand FROM word)
SELECT DISTINCT p_brand || '.' || prop AS read, ap FROM word JOIN pat ON (kind = 'prefix' AND starts_with(prop, t)) OR (kind = 'suffix' AND suffix(prop, t))""")
def op_field_wild(spark, sf):
    d = sized(spark, sf)
    reads = d.select(F.concat_ws(".", "p_brand", "prop").alias("read"), "prop").distinct()
    cuts = (("prefix", F.left("prop", F.length("prop") - 1)), ("suffix", F.right("prop", F.lit(3))))
    kinds = [d.select(F.lit(kind).alias("kind"), cut.alias("text"), F.concat("p_type", "p_brand").alias("ap")) for kind, cut in cuts]
    return lookups.wild_fields(reads, kinds[0].union(kinds[1]).distinct())


@query(f"""WITH {TREE}, scope AS (SELECT src AS module, src AS member FROM tree UNION SELECT dst, dst FROM tree UNION SELECT src, dst FROM tree UNION SELECT dst, src FROM tree)
SELECT DISTINCT scope.module, c_mktsegment AS prop, c_custkey AS ap FROM customer JOIN scope ON member = 'n' || c_nationkey""")
def op_field_scope(spark, sf):
    writes = table(spark, sf, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("module"), F.col("c_mktsegment").alias("prop"), F.col("c_custkey").alias("ap"))
    return lookups.scoped(writes, graph.neighbours(tree(spark, sf)))


@query(f"WITH {SIZED} SELECT DISTINCT r.p_type || r.p_brand AS read, w.p_partkey AS ap FROM word r JOIN word w USING (prop)")
def op_getter(spark, sf):
    d, one = sized(spark, sf), F.lit(0).alias("module")
    return lookups.fields(d.select(F.concat("p_type", "p_brand").alias("read"), one, "prop").distinct(), d.select(one, "prop", F.col("p_partkey").alias("ap")).distinct())


NAMES = """(SELECT DISTINCT {id} AS id, CASE p_size % 3 WHEN 0 THEN 'literal' WHEN 1 THEN 'prefix' ELSE 'suffix' END AS kind,
  CASE p_size % 3 WHEN 0 THEN prop WHEN 1 THEN left(prop, length(prop) - 1 - p_size % 2) ELSE right(prop, 3 + p_size % 2) END AS t FROM word)"""


def event_names(spark: SparkSession, sf: str, column: str, name: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("literal"), F.lit("prefix"), F.lit("suffix")), F.col("p_size") % 3 + 1)
    n = F.col("p_size") % 2
    part = F.when(kind == "literal", F.col("prop")).when(kind == "prefix", F.left("prop", F.length("prop") - 1 - n)).otherwise(F.right("prop", 3 + n))
    return sized(spark, sf).select(F.col(column).alias(name), kind.alias("kind"), part.alias("text")).distinct()


@query(f"""WITH {SIZED}, e AS {NAMES.format(id='p_brand')}, o AS {NAMES.format(id='p_partkey')}
SELECT DISTINCT e.id AS emit, o.id AS callback FROM e JOIN o ON CASE
  WHEN e.kind = 'literal' AND o.kind = 'literal' THEN e.t = o.t WHEN e.kind = 'literal' AND o.kind = 'prefix' THEN starts_with(e.t, o.t) WHEN e.kind = 'literal' THEN suffix(e.t, o.t)
  WHEN e.kind = 'prefix' AND o.kind = 'literal' THEN starts_with(o.t, e.t) WHEN e.kind = 'prefix' AND o.kind = 'prefix' THEN starts_with(e.t, o.t) OR starts_with(o.t, e.t) WHEN e.kind = 'prefix' THEN false
  WHEN o.kind = 'literal' THEN suffix(o.t, e.t) WHEN o.kind = 'suffix' THEN suffix(o.t, e.t) OR suffix(e.t, o.t) ELSE false END""")
def op_listener(spark, sf):
    return lookups.listeners(event_names(spark, sf, "p_brand", "emit"), event_names(spark, sf, "p_partkey", "callback"))


BUILTIN = "b(prop, place) AS (VALUES " + ", ".join(f"('{p}', {k})" for p, k in lookups.BUILTIN_CALLBACKS) + ")"
CALLS = f"c AS (SELECT l_orderkey AS edge, CASE l_partkey % 16 {' '.join(f'WHEN {k} THEN {chr(39)}{p}{chr(39)}' for k, (p, _) in enumerate(lookups.BUILTIN_CALLBACKS))} ELSE 'other' END AS prop, l_linenumber - 1 AS pos, l_suppkey AS ap FROM lineitem)"


@query(f"WITH {BUILTIN}, {CALLS} SELECT DISTINCT edge, ap FROM c JOIN b USING (prop) WHERE place = pos OR place = -1")
def op_builtin_cb(spark, sf):
    names = F.array(*[F.lit(p) for p, _ in lookups.BUILTIN_CALLBACKS], *[F.lit("other")] * (16 - len(lookups.BUILTIN_CALLBACKS)))
    calls = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("edge"), F.element_at(names, (F.col("l_partkey") % 16 + 1).cast("int")).alias("prop"), (F.col("l_linenumber") - 1).alias("pos"), F.col("l_suppkey").alias("ap"))
    return lookups.builtin_callbacks(calls)


@query("SELECT DISTINCT l_orderkey AS edge, l_suppkey AS ap FROM lineitem WHERE l_linenumber = 1 AND l_tax >= 0.03 AND l_discount >= 0.05")
def op_promise(spark, sf):
    module, name = F.when(F.col("l_tax") >= 0.03, BUILT_IN).otherwise("lib"), F.when(F.col("l_discount") >= 0.05, "Promise").otherwise("Object")
    calls = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("edge"), module.alias("module"), name.alias("name"), (F.col("l_linenumber") - 1).alias("pos"), F.col("l_suppkey").alias("ap"))
    return lookups.constructed(calls)


@query("SELECT DISTINCT l_orderkey AS call, coalesce(CASE WHEN p_size < 25 THEN p_partkey END, -l_suppkey) AS callee FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def op_export_lookup(spark, sf):
    calls = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("call"), F.lit("f").alias("file"), F.col("l_partkey").alias("path"), (-F.col("l_suppkey")).alias("fallback"))
    return lookups.exports(calls, table(spark, sf, "part").where("p_size < 25").select(F.lit("f").alias("file"), F.col("p_partkey").alias("path"), F.col("p_partkey").alias("fn")))


# ---- advisories, modules, soundness


@query(f"""WITH RECURSIVE {REACH},
dep AS (SELECT DISTINCT library, [p_size, CAST(p_partkey % 10 AS INTEGER), 0] AS version FROM fn),
adv AS (SELECT p_partkey AS id, p_type || '-' || p_brand AS library, [CAST(floor(p_retailprice) AS INTEGER) % 50, 0, 0] AS low, [CAST(floor(p_retailprice) AS INTEGER) % 50 + 3, 9, 0] AS high, string_split(p_name, ' ') AS props FROM part),
hit AS (SELECT id, library, unnest(props) AS prop FROM adv WHERE EXISTS (SELECT 1 FROM dep WHERE dep.library = adv.library AND dep.version BETWEEN low AND high)),
own AS (SELECT node, library, unnest(string_split(p_name, ' ')) AS prop FROM fn)
SELECT id, count(DISTINCT node) AS functions FROM hit JOIN own USING (library, prop) WHERE node IN (SELECT node FROM reach) GROUP BY id""")
def op_scan_alarms(spark, sf):
    f, p = fns(spark, sf), table(spark, sf, "part")
    dep = f.select("library", F.array("p_size", (F.col("p_partkey") % 10).cast("int"), F.lit(0)).alias("version"))
    low = F.floor("p_retailprice").cast("int") % 50
    adv = p.select(F.col("p_partkey").alias("id"), F.concat_ws("-", "p_type", "p_brand").alias("library"), F.array(low, F.lit(0), F.lit(0)).alias("low"), F.array(low + 3, F.lit(9), F.lit(0)).alias("high"), F.split("p_name", " ").alias("props"))
    defs = f.select("library", F.explode(F.split("p_name", " ")).alias("prop"), F.col("node").alias("fn"))
    return matching.alarms(adv, dep, defs, reach(spark, sf))


PATTERN = """CASE p_size % 3 WHEN 0 THEN concat('call <', library, '>') WHEN 1 THEN concat('call {<', library, '>.{', array_join(split(p_name, ' '), ','), '},<', library, '>.none} [1, 9]')
  ELSE concat('call <', library, '>()') END"""


@query(f"""WITH RECURSIVE {REACH},
dep AS (SELECT DISTINCT library, [p_size, CAST(p_partkey % 10 AS INTEGER), 0] AS version FROM fn WHERE p_partkey % 10 <> 1),
adv AS (SELECT p_partkey AS id, p_type || '-' || p_brand AS library, p_size % 3 AS form, string_split(p_name, ' ') AS props FROM part WHERE EXISTS (
  SELECT 1 FROM dep WHERE library = p_type || '-' || p_brand AND version BETWEEN [CAST(floor(p_retailprice) AS INTEGER) % 50, 0, 0] AND [CAST(floor(p_retailprice) AS INTEGER) % 50 + 3, 9, 9])),
own AS (SELECT library, node AS fn FROM fn WHERE p_size < 25), given AS (SELECT src AS fn, min(dst) AS returned FROM call GROUP BY src),
word AS (SELECT node, library, unnest(string_split(p_name, ' ')) AS prop FROM fn),
hit AS (SELECT id, fn FROM adv JOIN own USING (library) WHERE form = 0 UNION SELECT id, node FROM (SELECT id, library, unnest(props) AS prop FROM adv WHERE form = 1) a JOIN word USING (library, prop)
  UNION SELECT id, returned FROM adv JOIN own USING (library) JOIN given USING (fn) WHERE form = 2)
SELECT id, count(DISTINCT fn) AS functions FROM hit WHERE fn IN (SELECT node FROM reach) GROUP BY id""")
def op_scan_patterns(spark, sf):
    f, p, number = fns(spark, sf), table(spark, sf, "part").withColumn("library", F.concat_ws("-", "p_type", "p_brand")), lambda *c: F.concat_ws(".", *[F.col(x) if isinstance(x, str) else x for x in c])
    low = F.floor("p_retailprice").cast("int") % 50
    adv = p.select(F.col("p_partkey").alias("id"), "library", number(low, F.lit("0.0")).alias("low"), number(low + 3, F.lit("9.9")).alias("high"), F.expr(PATTERN).alias("pattern"))
    early = F.when(F.col("p_partkey") % 10 == 1, "-rc.1").otherwise("")
    dep = f.select("library", F.concat(number("p_size", F.col("p_partkey") % 10, F.lit("0")), early).alias("version"))
    exported = f.where("p_size < 25").select("library", F.lit(None).cast("string").alias("prop"), F.col("node").alias("fn"))
    members = f.select("library", F.explode(F.split("p_name", " ")).alias("prop"), F.col("node").alias("fn"))
    returns = fn_edges(spark, sf).groupBy(F.col("src").alias("fn")).agg(F.min("dst").alias("returned"))
    return scan.alarms(adv, dep, exported.union(members), returns, reach(spark, sf))


@query(f"""WITH RECURSIVE {REACH} SELECT DISTINCT 'o' || l_orderkey AS module FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'N' AND l_tax >= 0.07 AND l_discount >= 0.07
  AND l_partkey * 100 + CAST(l_quantity AS BIGINT) IN (SELECT node FROM reach)""")
def op_side_effect(spark, sf):
    stored = ~((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N") & (F.col("l_tax") >= 0.07) & (F.col("l_discount") >= 0.07))
    loads = table(spark, sf, "lineitem").select(fn_id().alias("fn"), named("o", "l_orderkey").alias("module"), stored.alias("stored"))
    return graph.loaded_for_effect(loads, reach(spark, sf))


@query("""WITH dyn AS (SELECT DISTINCT l_suppkey AS source, l_partkey AS target FROM lineitem), st AS (SELECT DISTINCT l_suppkey AS source, l_partkey AS target FROM lineitem WHERE l_returnflag <> 'R'),
d AS (SELECT target % 97 = 0 AS named, EXISTS (SELECT 1 FROM st WHERE st.source = dyn.source AND st.target = dyn.target) AS has, source IN (SELECT source FROM st) AS known FROM dyn)
SELECT CASE WHEN has AND named THEN 'unexpectedly_sound' WHEN has THEN 'sound' WHEN named THEN 'known_unsound' WHEN NOT known THEN 'missing_source' ELSE 'missing' END AS class, count(*) AS edges FROM d GROUP BY 1""")
def op_soundness(spark, sf):
    every = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), "l_returnflag")
    pairs = every.select("source", "target")
    return matching.classified(pairs, every.where("l_returnflag <> 'R'").select("source", "target"), pairs.where("target % 97 = 0"))


# ---- events


def run(spark: SparkSession, sf: str) -> DataFrame:
    return runs(table(spark, sf, "events"))


SEQ = ("ts", "event_id")
PENDING = f"WITH {RUNS}, {CALLER} SELECT stream, caller AS source, key AS target FROM c WHERE kind = 'enter' AND caller >= 0"
LOADS = f"WITH {RUNS}, o AS (SELECT *, bool_or(start) OVER (PARTITION BY stream ORDER BY ts, event_id) AS is_on FROM run) SELECT stream, event_id, k AS key FROM o WHERE is_on AND kind = 'load' AND k >= 50"


@query(PENDING)
def op_pending_caller(spark, sf):
    return events.call_edges(run(spark, sf), *SEQ).select("stream", F.col("caller").alias("source"), F.col("key").alias("target"))


@query(f"WITH {RUNS} SELECT event_id, bool_or(start) OVER (PARTITION BY stream ORDER BY ts, event_id) AS started FROM run")
def op_sticky(spark, sf):
    return run(spark, sf).select("event_id", events.started(F.col("start"), *SEQ).alias("started"))


@query(f"WITH {RUNS} SELECT event_id, coalesce(last_value(CASE WHEN start THEN true WHEN kind = 'clear' THEN false END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY ts, event_id), false) AS is_on FROM run")
def op_bracket(spark, sf):
    return run(spark, sf).select("event_id", events.bracketed(F.col("start"), F.col("kind") == events.CLEAR, *SEQ).alias("is_on"))


@query(f"WITH {RUNS} SELECT stream, k, event_id FROM (SELECT *, row_number() OVER (PARTITION BY stream, k ORDER BY ts, event_id) AS n FROM run) WHERE n = 1")
def op_first_wins(spark, sf):
    return events.first_wins(run(spark, sf), ["stream", "k"], *SEQ).select("stream", "k", "event_id")


@query(f"WITH {RUNS.replace('event_id AS key', chr(67) + 'AST(regexp_extract(props, ' + chr(39) + '([0-9]+)' + chr(39) + ', 1) AS BIGINT) AS key')}, {CALLER} SELECT DISTINCT caller AS source, key AS target, kind = 'load' AS is_load FROM c WHERE kind IN ('enter', 'load') AND caller >= 0")
def op_dyn_edges(spark, sf):
    return events.dynamic_edges(run(spark, sf).withColumn("key", F.col("k")), *SEQ)


@query(LOADS)
def op_whitelist(spark, sf):
    allowed = spark.range(50).toDF("key")
    return events.illegal_loads(run(spark, sf).withColumn("key", F.col("k")), allowed, F.col("start"), *SEQ).select("stream", "event_id", "key")


def streamed(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    d = spark.readStream.schema(rows.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return runs(d).withColumn("ts", F.col("ts").cast("timestamp"))


@query(PENDING)
def op_streaming_pending_caller(spark, sf):
    return live.drained(live.call_edges(streamed(spark, sf)))


@query(LOADS)
def op_streaming_whitelist(spark, sf):
    return live.drained(live.illegal_loads(streamed(spark, sf).withColumn("key", F.col("k")), spark.range(50).toDF("key")))


# ---- texts

TAG = "<(p|h1|b|li|div)[ >]"


@query(f"SELECT page_id, CAST(len(regexp_extract_all(html, '{TAG}')) AS BIGINT) AS functions FROM pages")
def op_function_count(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_count("html", F.lit(TAG)).cast("long").alias("functions"))


@query(f"""SELECT sum(len(regexp_extract_all(html, '{TAG}')))::BIGINT AS loads, sum(len(regexp_extract_all(regexp_replace(html, '(?s)<nav>.*?</nav>', '', 'g'), '{TAG}')))::BIGINT AS top_level, sum(len(regexp_extract_all(html, '<a ')))::BIGINT AS imports FROM pages""")
def op_load_summary(spark, sf):
    n = lambda c, tag: F.coalesce(F.sum(F.regexp_count(c, F.lit(tag))), F.lit(0)).cast("long")
    outside = F.regexp_replace("html", "(?s)<nav>.*?</nav>", "")
    return table(spark, sf, "pages").agg(n("html", TAG).alias("loads"), n(outside, TAG).alias("top_level"), n("html", "<a ").alias("imports"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+:/(/[^?#]*)', 1) AS path FROM pages), g(form, re) AS (VALUES ('/**/{en,fr}/*', '^/(.*/)?(en|fr)/[^/]*$'), ('/*.example.com/**/1*', '^/[^/]*\.example\.com/(.*/)?1[^/]*$'), ('/*/de/**/*', '^/[^/]*/de/(.*/)?[^/]*$'))
SELECT page_id, form FROM p, g WHERE regexp_matches(path, re)""")
def op_glob(spark, sf):
    forms = ["/**/{en,fr}/*", "/*.example.com/**/1*", "/*/de/**/*"]
    path = F.regexp_extract("url", r"^[a-z]+:/(/[^?#]*)", 1)
    hit = F.array_compact(F.array(*[F.when(path.rlike(globs.parse(g).regex()), F.lit(g)) for g in forms]))
    return table(spark, sf, "pages").select("page_id", F.explode(hit).alias("form"))


@query("SELECT page_id, CASE WHEN contains(p, 'node_modules/') THEN regexp_extract(p, '^(.*node_modules/[^/]+)', 1) ELSE regexp_extract(p, '([^/]*)$', 1) END AS module FROM (SELECT page_id, replace(url, '/en/', '/node_modules/') AS p FROM pages)")
def op_module_estimate(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.module_of(F.replace("url", F.lit("/en/"), F.lit("/node_modules/"))).alias("module"))


@query("SELECT event_id, 'f' || user_id || ':' || (event_id % 90) || ':' || (event_id % 7) || ':' || (event_id % 90 + 2) || ':' || (event_id % 5) AS place, (event_id % 90) || ':' || (event_id % 90 + 2) AS lines FROM events")
def op_loc_parse(spark, sf):
    e = F.col("event_id")
    raw = F.format_string("(f%d:%d:%d:%d:%d)", "user_id", e % 90, e % 7 + 1, e % 90 + 2, e % 5 + 1)
    d = table(spark, sf, "events").select("event_id", text.location(raw).alias("loc"))
    return d.select("event_id", text.location_string(F.col("loc.file"), F.col("loc")).alias("place"), text.lines_key(F.col("loc")).alias("lines"))


@query("SELECT doc_id, sha1(text) || '-' || source || '.json' AS model FROM documents")
def op_sha1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat(F.sha1("text"), F.lit("-"), "source", F.lit(".json")).alias("model"))


@query(f"""WITH {EDGE} SELECT '  "' || src || '" -> "' || dst || '";' AS line FROM edge""")
def op_dot_text(spark, sf):
    return part_edges(spark, sf).select(text.dot_line(F.col("src"), F.col("dst")).alias("line"))


@query(r"SELECT page_id, regexp_replace(url, '([%_#])', '\\\1', 'g') AS url FROM pages")
def op_latex(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.latex(F.col("url")).alias("url"))
