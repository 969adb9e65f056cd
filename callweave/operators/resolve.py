"""The files that imports lead to, as joins of candidate paths with a listing of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions import names
from callweave.functions.names import BUILT_IN, is_builtin_module
from callweave.operators.construct import NOT_FOUND

#: What may be left out at the end of a file's name, and of a folder's own file, in the order tried.
ENDINGS, INDEX = ("", ".js", ".json", ".node"), ("/index.js", "/index.json", "/index.node")


def folders(folder: Column) -> Column:
    """The package folders that a file in folder sees, the nearest first: node_modules in each folder above, but not in one that has this name itself."""
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    above = F.transform(F.reverse(F.sequence(F.lit(0), F.size(parts))), lambda n: F.slice(parts, F.lit(1), n))
    own = F.filter(above, lambda p: (F.size(p) == 0) | (F.element_at(F.concat(F.array(F.lit("")), p), -1) != "node_modules"))
    return F.transform(own, lambda p: F.concat(F.lit("/"), F.array_join(F.concat(p, F.array(F.lit("node_modules"))), "/")))


def bases(folder: Column, spec: Column) -> Column:
    """What a specifier may stand for as seen from a folder, the first choice first: one path for `/x`, `./x` and `../x`, else one in each of folders()."""
    plain = spec.startswith("/") | spec.isin(".", "..") | spec.startswith("./") | spec.startswith("../")
    return F.when(plain, F.array(names.resolved(folder, spec))).otherwise(F.transform(folders(folder), lambda at: F.concat(at, F.lit("/"), spec)))


def _tried(base: Column, main: Column) -> Column:
    """(path, rank) of all that may lie behind a base: the file, then as a folder its main file, main folder and index."""
    at = lambda b, ends: [F.concat(b, F.lit(e)) for e in ends]
    inner = names.resolved(base, main)
    as_file = F.when(~base.endswith("/"), F.array(*at(base, ENDINGS))).otherwise(F.array().cast("array<string>"))
    through = F.when(main.isNotNull() & (main != ""), F.array(*at(inner, ENDINGS), *at(inner, INDEX))).otherwise(F.array().cast("array<string>"))
    every = F.concat(as_file, through, F.array(*at(F.regexp_replace(base, "/$", ""), INDEX)))
    return F.transform(every, lambda p, i: F.struct(p.alias("path"), i.alias("rank")))


def resolved(asks: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """asks (file, spec) -> file, spec, target: the file that spec leads to from file.

    files (path): all there are; packages (folder, main): the main files that package descriptions name, null for none; paths are absolute.
    A module of the run time leads to BUILT_IN, what is nowhere to MODULE_NOT_FOUND; so do null and empty specifiers. Files that ask for
    one thing from one folder are one question, and what lies behind a base is found once, whoever asks; the least rank counts.
    """
    asked = asks.select("file", "spec", names.dirname(F.col("file")).alias("folder"))
    builtin = is_builtin_module(F.col("spec"))
    once = asked.where("spec IS NOT NULL AND spec <> ''").where(~builtin).select("folder", "spec").distinct()
    wanted = once.select("folder", "spec", F.posexplode(bases(F.col("folder"), F.col("spec"))).alias("order", "base"))
    main = packages.groupBy("folder").agg(F.min("main").alias("main")).withColumn("own", F.col("folder")).drop("folder")
    behind = wanted.select("base").distinct().join(main, F.regexp_replace("base", "/$", "") == F.col("own"), "left")
    tried = behind.select("base", F.explode(_tried(F.col("base"), F.col("main"))).alias("x")).select("base", "x.path", "x.rank")
    there = tried.join(files.select("path").distinct(), "path").groupBy("base").agg(F.min_by("path", "rank").alias("target"))
    found = wanted.join(there, "base").groupBy("folder", "spec").agg(F.min_by("target", "order").alias("target"))
    out = asked.join(found, ["folder", "spec"], "left")
    return out.select("file", "spec", F.when(builtin, BUILT_IN).otherwise(F.coalesce("target", F.lit(NOT_FOUND))).alias("target"))
