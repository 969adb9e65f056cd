"""Recorded inputs: advisories, dependency listings, observed edges, files; and the sinks of results."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callweave.functions.text import dot_edge, dot_line, dot_node, latex_row

ADVISORY = "library string, versionMin string, versionMax string, pattern string, id int, comment string"
PLACE = "struct<source:string,start:struct<line:int,column:int>,end:struct<line:int,column:int>>"
OBSERVED = f"`from` {PLACE}, `to` {PLACE}, isLoad boolean"


def advisories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ADVISORY).option("multiLine", True).option("mode", "FAILFAST").json(path)


def observed_edges(spark: SparkSession, path: str, runner: str = "runner") -> DataFrame:
    """(source, target, is_load) by files and lines, without edges that touch the runner."""
    d = spark.read.schema(OBSERVED).option("multiLine", True).option("mode", "FAILFAST").json(path)
    at = lambda c: F.concat_ws(":", F.col(f"{c}.source"), F.col(f"{c}.start.line"), F.col(f"{c}.end.line"))
    rows = d.where(~F.col("from.source").contains(runner) & ~F.col("to.source").contains(runner))
    return rows.select(at("from").alias("source"), at("to").alias("target"), F.col("isLoad").alias("is_load")).distinct()


def tree_edges(lines: DataFrame) -> DataFrame:
    """(parent, child) from an indented listing: lines (run, line_no, line), two columns a level, names after the tree marks.

    A line's parent is the last one before it that stands one level higher.
    """
    name = F.regexp_extract("line", r"([^\s│├└─┬|`+-]\S*)", 1)
    depth = F.floor(F.length(F.regexp_extract("line", r"^([\s│├└─┬|`+-]*)", 1)) / 2)
    rows = lines.select("run", "line_no", name.alias("child"), depth.alias("depth")).where("child <> ''")
    before = W.partitionBy("run").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    most = rows.agg(F.max("depth")).first()[0] or 0
    last = [F.last(F.when(F.col("depth") == k, F.col("child")), ignorenulls=True).over(before) for k in range(most)]
    parent = F.get(F.array(*last), F.col("depth") - 1) if last else F.lit(None).cast("string")
    return rows.withColumn("parent", F.when(F.col("depth") > 0, parent)).where("parent IS NOT NULL").select("run", "parent", "child").distinct()


def files(spark: SparkSession, path: str, names: str = "*", outside: str | None = None) -> DataFrame:
    """(path, sha1, content) of the files below path; those whose path matches `outside` are left out."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(path)
    d = d.where(~F.col("path").rlike(outside)) if outside else d
    return d.select("path", F.sha1("content").alias("sha1"), "content")


def _flat(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for path, text in zip(pdf["path"], pdf["value"], strict=True):
            open_ = [json.loads(text).get("dependencies") or {}]
            while open_:
                for name, of in open_.pop().items():
                    rows.append((path, name, of.get("version")))
                    open_.append(of.get("dependencies") or {})
        yield pd.DataFrame(rows, columns=["path", "library", "version"])


def dependencies(spark: SparkSession, path: str) -> DataFrame:
    """(path, library, version): every entry of recorded dependency listings, one JSON object a file, however deep; repeats are kept. A file that is no JSON is an error; one without dependencies gives nothing."""
    texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), "value")
    return texts.mapInPandas(_flat, "path string, library string, version string")


def clients(spark: SparkSession, path: str) -> DataFrame:
    """(name, version): the programs that a list names."""
    d = spark.read.schema("packageName string, packageVersion string").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return d.toDF("name", "version")


def allowed_modules(spark: SparkSession, path: str) -> DataFrame:
    """(key): the names of a file that holds one JSON list of them."""
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.explode(F.from_json("value", "array<string>", {"mode": "FAILFAST"})).alias("key")).distinct()


def package_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, object): JSON objects of whatever form, one a file, as variants."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.parse_json("value").alias("object"))


def write_json(rows: DataFrame, path: str) -> None:
    """A result as JSON lines: modules, observed edges, illegal loads."""
    rows.write.json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes (node, node_kind) and edges (source, target, label) as a directed graph in the DOT language: its files in order of names are one text, nodes first, each line once."""
    lines = graph_lines(nodes, edges).union(nodes.sparkSession.createDataFrame([(-1, "digraph {"), (2, "}")], "part int, line string"))
    lines.orderBy("part", "line").select(F.col("line").alias("value")).write.text(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """Edges (source, target) alone as such a graph, without labels."""
    lines = edges.select(F.lit(1).alias("part"), dot_line(F.col("source"), F.col("target")).alias("line")).distinct()
    lines = lines.union(edges.sparkSession.createDataFrame([(-1, "digraph {"), (2, "}")], "part int, line string"))
    lines.orderBy("part", "line").select(F.col("line").alias("value")).write.text(path)


def labelled(edges: DataFrame, place: bool = True) -> DataFrame:
    """edges (source, target, node_key, file, sl, sc) with the label of the calls: the callee's node and where the call is written."""
    at = F.concat_ws(":", "file", F.col("sl").cast("string"), F.col("sc").cast("string"))
    return edges.select("source", "target", (F.concat(F.col("node_key"), F.lit(" "), at) if place else F.col("node_key")).alias("label"))


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): 0 for the lines of nodes, 1 for those of edges."""
    n = nodes.select(F.lit(0).alias("part"), dot_node(F.col("node"), F.col("node_kind")).alias("line"))
    return n.union(edges.select(F.lit(1), dot_edge(F.col("source"), F.col("target"), F.col("label")))).distinct()


def latex_table(rows: DataFrame) -> str:
    """A small result as a table with a rule on every side: one line a row, in the order of all columns."""
    lines = rows.select(*rows.columns, latex_row(*[F.col(c) for c in rows.columns]).alias("__line")).orderBy(*rows.columns)
    body = "\n".join(r["__line"] for r in lines.select("__line").toLocalIterator())
    return f"\\begin{{tabular}}{{|{'c|' * len(rows.columns)}}}\n\\hline\n{body}\n\\end{{tabular}}"


def benchmark_inputs(spark: SparkSession, path: str, resources: str) -> DataFrame:
    """(package, ord, input): the inputs that a file lists for each package, `{RES}` in them replaced once by the package's folder of resources."""
    texts = spark.read.text(path, wholetext=True)
    rows = texts.select(F.explode(F.from_json("value", "map<string,array<string>>", {"mode": "FAILFAST"})).alias("package", "inputs")).select("package", F.posexplode("inputs").alias("ord", "input"))
    at = F.instr("input", "{RES}")
    return rows.select("package", "ord", F.when(at > 0, F.concat(F.left("input", at - 1), F.lit(f"{resources}/"), F.col("package"), F.substr("input", at + 5))).otherwise(F.col("input")).alias("input"))


def scanned(listing: DataFrame, endings: list[str] | None = None, outside: list[str] | None = None) -> DataFrame:
    """(path, ord): the files of listing (path), those in folders before the files beside these folders, else by name.

    endings: which a name with a dot must have; names without one always pass. outside: endings of paths that are left out.
    """
    name = F.regexp_extract("path", "([^/]*)$", 1)
    keep = F.lit(True)
    if endings is not None:
        keep = ~name.contains(".") | F.greatest(*[F.col("path").endswith(e) for e in endings], F.lit(False))
    for e in outside or ():
        keep = keep & ~F.col("path").endswith(e)
    # a folder sorts before a file at each level
    parts = F.split("path", "/")
    order = F.transform(parts, lambda x, i: F.struct((i == F.size(parts) - 1).alias("last"), x.alias("name")))
    return listing.where(keep).select("path", order.alias("ord"))
