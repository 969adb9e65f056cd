"""Reachability and what is read off reachable graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callweave.functions.names import resolved
from callweave.plans.fixpoint import closure, reached
from callweave.session import dealt, written


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst, ...) that leave nodes (node)."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")


def subtrees(edges: DataFrame) -> DataFrame:
    """(module, member): each module of edges (src, dst) with itself and all below it."""
    own = edges.select("src").union(edges.select("dst")).distinct().toDF("module")
    below = closure(edges).toDF("module", "member")
    return own.select("module", F.col("module").alias("member")).union(below).distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    """(module, member): each module with itself, its children and its parents."""
    own = edges.select("src").union(edges.select("dst")).distinct().toDF("module")
    pairs = own.select("module", F.col("module").alias("member")).union(edges.select("src", "dst")).union(edges.select("dst", "src"))
    return pairs.distinct()


def unreached(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return nodes.join(reached(edges, seeds), "node", "left_anti")


def traces(edges: DataFrame, targets: DataFrame, depth: int = 10) -> DataFrame:
    """(target, step, node): from each target back over the first edge, by `ord`, that leads to it, and so on for `depth` steps or as long as there is one."""
    first, _ = dealt(edges.groupBy("dst").agg(F.min_by("src", F.struct("ord", "src")).alias("src")), "dst")  # every step looks it up as it lies
    at = written(targets.select(F.col("node").alias("target"), "node"))
    out = at.select("target", F.lit(0).alias("step"), "node")
    for k in range(1, depth + 1):
        at = written(at.join(first, F.col("node") == F.col("dst")).select("target", F.col("src").alias("node")))
        out = out.union(at.select("target", F.lit(k).alias("step"), "node"))
    return out


def preorder(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth, pos): the order in which a walk from roots (node) comes by what edges (src, dst, ord) lead to, each node before those below it, children by ord.

    Where several edges lead to a node it stands below the one that is nearest to a root, of these the first by ord; roots follow each
    other in order of their names. One pass up the levels sums the sizes of what stands below each node, one pass down adds those of
    earlier siblings: two joins a level, and no walk in one place.
    """
    far = written(reached(edges, roots))
    at = lambda name, depth: far.select(F.col("node").alias(name), F.col("depth").alias(depth))
    down = edges.join(at("src", "above"), "src").join(at("dst", "depth"), "dst").where("depth = above + 1")
    under = written(down.groupBy("dst", "depth").agg(F.min(F.struct("ord", "src")).alias("first")).select(F.col("dst").alias("node"), "depth", F.col("first.ord").alias("ord"), F.col("first.src").alias("parent")))
    deepest = far.agg(F.max("depth")).first()[0] or 0
    top = far.where("depth = 0").select("node", "depth", F.lit(None).cast(dict(edges.dtypes)["ord"]).alias("ord"), F.lit(None).cast(dict(edges.dtypes)["src"]).alias("parent"))
    rows, below = top.union(under.select("node", "depth", "ord", "parent")), None
    levels = []
    for d in range(deepest, -1, -1):
        own = rows.where(F.col("depth") == d)
        own = own.withColumn("size", F.lit(1).cast("long")) if below is None else own.join(below, "node", "left").withColumn("size", 1 + F.coalesce("below", F.lit(0))).drop("below")
        levels.append(written(own))
        below = levels[-1].groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("below"))
    earlier = W.partitionBy("parent").orderBy("ord", "node").rowsBetween(W.unboundedPreceding, -1)
    out = above = None
    for d, own in enumerate(reversed(levels)):
        own = own.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        if d:
            own = own.join(above, "parent").withColumn("pos", F.col("pos") + 1 + F.col("before"))
        else:
            own = own.withColumn("pos", F.col("before"))
        own = written(own.select("node", "depth", "pos"))
        above = own.select(F.col("node").alias("parent"), "pos")
        out = own if out is None else out.union(own)
    return out


def joined_graphs(*graphs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The relations of all graphs, by name, each with the rows that any graph has in it."""
    return {k: merged(*[g[k] for g in graphs if k in g]) for k in sorted(set().union(*graphs))}


def graph_counts(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: nodes, edges and different pairs of source and target, of nodes (node) and targets (edge, source, target)."""
    n = nodes.select("node").distinct().agg(F.count("*").alias("nodes"))
    e = targets.where("edge IS NOT NULL").select("edge").distinct().agg(F.count("*").alias("edges"))
    p = targets.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct().agg(F.count("*").alias("pairs"))
    return n.crossJoin(e).crossJoin(p)  # one row by one row


def merged(*graphs: DataFrame) -> DataFrame:
    """The rows of all graphs, once each."""
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g)
    return out.distinct()


def overridden(left: DataFrame, right: DataFrame) -> DataFrame:
    """Maps (key, value), unique keys: right's value where both have one."""
    both = left.withColumn("rank", F.lit(0)).unionByName(right.withColumn("rank", F.lit(1)))
    return both.groupBy("key").agg(F.max_by("value", "rank").alias("value"))


def capped(aliases: DataFrame, most: int = 30) -> DataFrame:
    """aliases (prop, ap, string) where a prop with over `most` different values has the one value Unknown instead."""
    a = aliases.distinct()
    n = a.groupBy("prop").agg(F.count("*").alias("n"))
    return a.join(n, "prop").select("prop", F.when(F.col("n") > most, "Unknown").otherwise(F.col("ap")).alias("ap")).distinct()


def metrics(nodes: DataFrame) -> DataFrame:
    """nodes (node, module, package): one row with functions, modules, and packages besides the client's own."""
    return nodes.agg(F.count_distinct("node").alias("functions"), F.count_distinct("module").alias("modules"), (F.count_distinct("package") - 1).alias("packages"))


def used_modules(reachable: DataFrame, homes: DataFrame, usage: DataFrame, paths: DataFrame) -> DataFrame:
    """(module): the files that paths begin at which reachable functions (node) use, or the main functions of the modules that these are in.

    homes (node, main): each function's module's main function; usage (fn, ap); paths (ap, root, root_file) as in paths.rooted(). Paths
    that don't begin at an import name no module.
    """
    main = homes.join(reachable.select("node"), "node", "left_semi").select(F.col("main").alias("fn"))
    users = reachable.select(F.col("node").alias("fn")).union(main).distinct()
    used = usage.join(users, "fn", "left_semi").select("ap").distinct()
    return paths.where("root = 'import'").join(used, "ap", "left_semi").select(F.col("root_file").alias("module")).distinct()


def module_files(modules: DataFrame, cwd: str = "/") -> DataFrame:
    """(file): the files of modules (module), as absolute paths; built-in and internal modules, whose names have no /, are left out."""
    return modules.where(F.col("module").contains("/")).select(resolved(F.lit(cwd), F.col("module")).alias("file")).distinct()


def loaded_for_effect(loads: DataFrame, reachable: DataFrame) -> DataFrame:
    """(module): modules that reachable functions (node) load by a statement of its own. loads (fn, module, stored): stored tells whether what the load gives is used where it stands; a module that is also loaded so is among them."""
    return loads.where(~F.col("stored")).join(reachable.select(F.col("node").alias("fn")), "fn", "left_semi").select("module").distinct()


def modules_reached(nodes: DataFrame, prefix: str = "") -> DataFrame:
    """nodes (node, module): one row with how many modules begin with prefix."""
    return nodes.where(F.col("module").startswith(prefix)).agg(F.count_distinct("module").alias("modules"))


def dependency_counts(edges: DataFrame) -> DataFrame:
    """(run, dependencies): how many lines stand below the first in each listing, edges (run, parent, child) with one row for each line."""
    return edges.groupBy("run").agg(F.count("*").alias("dependencies"))


def no_functions(loaded: DataFrame, models: DataFrame) -> DataFrame:
    """(module): loaded modules (module) whose model (module, main), main as JSON, is neither a place nor an object: something else than a function or a plain object was exported. Modules without a model, or without an entry in it, are left out."""
    main = F.trim("main")
    known = models.where(main.isNotNull() & ~main.isin("", "null", "false", "0", '""', '"object"') & ~main.startswith("{") & ~main.startswith("["))
    return loaded.select("module").distinct().join(known, "module", "left_semi")


def without_arguments(edges: DataFrame, first_only: bool = False) -> DataFrame:
    """Edges (edge_id, args, ...) as their variants without any, or without the first, argument; ids tell them from the edges themselves."""
    args = F.slice("args", F.lit(2), F.greatest(F.size("args") - 1, F.lit(0))) if first_only else F.slice("args", 1, 0)
    return edges.withColumn("args", args).withColumn("edge_id", F.concat(F.col("edge_id").cast("string"), F.lit("-1" if first_only else "-0")))
