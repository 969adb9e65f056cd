"""Advisory patterns asked of a program's access paths: all of them go from imports upward together, a join a step."""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions import patterns
from callweave.operators.paths import CALL, IMPORT, PROP
from callweave.session import dealt, written


def _parts(path: patterns.Path, into: list[patterns.Path]) -> list[patterns.Path]:
    """into with the path and the paths within it, once each, those within first."""
    for below in path.paths if isinstance(path, patterns.Either) else () if isinstance(path, patterns.Module) else (path.on,):
        _parts(below, into)
    if path not in into:
        into.append(path)
    return into


def _height(path: patterns.Path) -> int:
    """How many properties and calls stand on one another in it."""
    if isinstance(path, patterns.Module):
        return 0
    return max(map(_height, path.paths)) if isinstance(path, patterns.Either) else 1 + _height(path.on)


def _described(rows: DataFrame, parts: list[patterns.Path]) -> DataFrame:
    """(ap, parts): the numbers of the parts that describe each of rows (ap, kind, name, below), below those of what it stands on; rows without any are left out."""
    met = {}
    for path in parts:
        if isinstance(path, patterns.Either):
            met[path] = functools.reduce(Column.__or__, [met[p] for p in path.paths])
        elif isinstance(path, patterns.Module):
            met[path] = (F.col("kind") == IMPORT) & F.col("name").rlike(path.glob.regex())
        else:
            own = F.col("kind") == CALL if isinstance(path, patterns.Called) else (F.col("kind") == PROP) & F.col("name").isin(*path.names)
            met[path] = own & F.array_contains("below", parts.index(path.on))
    return rows.select("ap", F.array_compact(F.array(*[F.when(met[p], k) for k, p in enumerate(parts)])).alias("parts")).where(F.size("parts") > 0)


def matches(paths: DataFrame, args: DataFrame, texts: Iterable[str]) -> DataFrame:
    """(pattern, ap): the paths that each pattern is about, once each.

    paths (ap, kind, on, name, default), args (ap, pos, ...), the arguments that calls have. `import` is about imports whose name is one
    of the glob's, `importD` about those of a module's default only; `read` about properties read, `readO` about those that are not
    called where they are read; `call` about calls of what the path describes, `callR` likewise, with as many arguments as every bound
    allows: one more than the last position that has any. A pattern is parsed once on the driver, so texts is a list of an advisory file's size.

    All patterns are asked at once: paths are written once, dealt by what they stand on, and looked up once for each step of the highest pattern.
    """
    spark, parts, asked = paths.sparkSession, [], []
    for text in dict.fromkeys(texts):
        p = patterns.parse(text)
        path = patterns.Called(p.path) if p.kind in patterns.CALLS else p.path
        _parts(path, parts)
        bounds = (max(a for a, _ in p.bounds), min(b for _, b in p.bounds)) if p.bounds else (None, None)
        asked.append((parts.index(path), text, "bounded" if p.bounds else p.kind, *bounds))
    if not asked:
        return spark.createDataFrame([], "pattern string, ap string")
    every, _ = dealt(paths.select("ap", "kind", "on", "name", *[c for c in ("default",) if c in paths.columns]), "on")
    level = written(_described(every.where(F.col("kind") == IMPORT).withColumn("below", F.array().cast("array<int>")), parts))
    found = level
    for _ in range(max(map(_height, parts))):
        level = written(_described(every.select(F.col("ap").alias("own"), "kind", "on", "name").join(level.toDF("on", "below"), "on").withColumnRenamed("own", "ap"), parts))
        found = found.union(level)
    of = F.broadcast(spark.createDataFrame(asked, "part int, pattern string, form string, low int, high int"))  # as many rows as patterns
    found = found.select("ap", F.explode("parts").alias("part")).join(of, "part").select("pattern", "ap", "form", "low", "high").distinct()
    kinds = {form for _, _, form, _, _ in asked}
    if len(kinds & {"importD", "readO", "bounded"}) > 0:
        found = written(found)
    out = found.where(~F.col("form").isin("importD", "readO", "bounded"))
    if "importD" in kinds:
        out = out.union(found.where("form = 'importD'").join(every.where("default").select("ap"), "ap", "left_semi").select(out.columns))
    if "readO" in kinds:
        called = every.where(F.col("kind") == CALL).select(F.col("on").alias("ap"))
        out = out.union(found.where("form = 'readO'").join(called, "ap", "left_anti").select(out.columns))
    if "bounded" in kinds:
        one = found.where("form = 'bounded'")
        count = args.join(one.select("ap"), "ap", "left_semi").groupBy("ap").agg((F.max("pos") + 1).alias("given"))
        out = out.union(one.join(count, "ap", "left").where(F.coalesce("given", F.lit(0)).between(F.col("low"), F.col("high"))).select(out.columns))
    return out.select("pattern", "ap")
