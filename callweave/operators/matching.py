"""Advisories against versions and reachable functions; static against observed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.operators.lookups import sets_of


def version(text: Column) -> Column:
    """1.2.3-pre+build as an array of numbers; missing parts are 0."""
    core = F.split(F.regexp_extract(text, r"^v?([0-9.]+)", 1), r"\.")
    return F.transform(F.array(*[F.get(core, F.lit(i)) for i in range(3)]), lambda x: F.coalesce(F.try_to_number(x, F.lit("999999999")).cast("int"), F.lit(0)))


def prerelease(text: Column) -> Column:
    return F.regexp_extract(text, r"^v?[0-9.]+(-[0-9A-Za-z.-]+)", 1) != ""


def vulnerable(advisories: DataFrame, dependencies: DataFrame) -> DataFrame:
    """advisories (id, library, low, high, ...) of which a dependency (library, version) lies in low to high, both included."""
    have = dependencies.select("library", "version").distinct()
    return advisories.alias("a").join(have.alias("d"), (F.col("a.library") == F.col("d.library")) & (F.col("d.version") >= F.col("a.low")) & (F.col("d.version") <= F.col("a.high")), "left_semi")


def alarms(advisories: DataFrame, dependencies: DataFrame, definitions: DataFrame, reachable: DataFrame) -> DataFrame:
    """(id, functions): advisories (id, library, low, high, props) that concern an installed version, with how many reachable definitions (library, prop, fn) they name. A null id stays one."""
    named = vulnerable(advisories, dependencies).select("id", "library", F.explode("props").alias("prop"))
    sets, who = sets_of(named, ["library", "prop"])  # advisories that name the same are counted once
    own = definitions.select("library", "prop", "fn").join(reachable.select(F.col("node").alias("fn")), "fn", "left_semi")
    counted = sets.join(own, ["library", "prop"]).groupBy("set").agg(F.count_distinct("fn").alias("functions"))
    return who.join(counted, "set").select(F.explode("ids").alias("of"), "functions").select("of.id", "functions")


def classified(dynamic: DataFrame, static: DataFrame, known_unsound: DataFrame) -> DataFrame:
    """(class, edges): dynamic (source, target) edges by what static (source, target) edges have of them.

    sound: the edge; unexpectedly_sound: also it, though known_unsound (source, target) names it; known_unsound: not it, and named;
    missing_source: no static edge leaves its source; missing: others.
    """
    s = static.distinct().withColumn("edge_known", F.lit(True))
    k = known_unsound.distinct().withColumn("named", F.lit(True))
    left = static.select("source").distinct().withColumn("source_known", F.lit(True))
    d = dynamic.distinct().join(s, ["source", "target"], "left").join(k, ["source", "target"], "left").join(left, "source", "left")
    has = F.coalesce("edge_known", F.lit(False))
    named = F.coalesce("named", F.lit(False))
    kind = F.when(has & named, "unexpectedly_sound").when(has, "sound").when(named, "known_unsound").when(F.col("source_known").isNull(), "missing_source").otherwise("missing")
    return d.groupBy(kind.alias("class")).agg(F.count("*").alias("edges"))
