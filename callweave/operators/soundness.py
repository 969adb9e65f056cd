"""Observed call edges held against a static graph, edge by edge, in twelve tallies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FUNCTION, MODULE, UNRESOLVED = "function", "module", "unresolved"
#: What a row beside an observed edge says of its source.
STATIC, UNSOUND, ABSENT = 0, 1, 2


@dataclass(frozen=True)
class Rules:
    """What is known of the observations beforehand. Tables are small lists that people keep; each is joined by key.

    skipped: parts of file names that make an edge no test at all; ignored: parts that make it count as sound;
    excused: parts of file names whose missing edges the last tally leaves out;
    unsound (source, target): edges known to be missing; absent (source): sources known to be missing;
    moved (target, lines): the lines that stand for an observed target; wrong_loads (target, file): files loaded under another name;
    alike (lines, file, place): observed lines that a function at another place stands for.
    """

    unsound: DataFrame
    absent: DataFrame
    moved: DataFrame
    wrong_loads: DataFrame
    alike: DataFrame
    skipped: tuple[str, ...] = ()
    ignored: tuple[str, ...] = ()
    excused: tuple[str, ...] = ()


def touches(parts: tuple[str, ...]) -> Column:
    """Whether the file of either end has one of the parts in its name."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains("source_file", F.lit(p)) | F.contains("target_file", F.lit(p))
    return out


def judged(observed: DataFrame, static: DataFrame, rules: Rules) -> DataFrame:
    """observed (edge, source, source_file, target, target_file, lines, is_load) -> edge, class, excused, and absent: whether its source was known to be missing.

    static (source, kind, file, lines, place): the targets of each call: a function with its file, its lines and its whole
    place, a module with its file, or an unresolved one. Classes, the first that fits: skipped, ignored, missing_source or
    expected_missing_source (no target at all), unresolved (one target is), then correct or unexpectedly_sound where a target
    fits, and missing_load, missing_call or known_unsound where none does. A load fits a module whose file has the observed
    name in its own, without a leading ../, or a name given in wrong_loads; a call fits a function on the lines observed, moved
    if that is known, or one that is alike. Each edge id is one observation.
    """
    first = rules.moved.dropDuplicates(["target"]).select("target", F.col("lines").alias("moved"))
    wrong = rules.wrong_loads.groupBy("target").agg(F.collect_set("file").alias("wrong"))
    o = observed.join(first.join(wrong, "target", "full"), "target", "left").withColumn("lines", F.coalesce("moved", "lines"))
    o = o.select("edge", "source", "source_file", "target", "target_file", "lines", "is_load", "wrong")
    o = o.repartition("source").groupBy(o.columns).agg(F.count("*").alias("times"))
    alike = rules.alike.groupBy(F.col("file").alias("static_file"), "place").agg(F.collect_set("lines").alias("alike"))
    t = static.select("source", F.lit(STATIC).alias("role"), "kind", F.col("file").alias("static_file"), F.col("lines").alias("static_lines"), "place").distinct()
    t = t.join(alike, ["static_file", "place"], "left").drop("place")
    # what is known of a source beforehand goes with its static targets, so that all of an edge meets in one join by source
    none = F.lit(None).cast("string")
    t = t.select("source", "role", "kind", "static_file", "static_lines", "alike")
    t = t.union(rules.unsound.select("source", F.lit(UNSOUND), none, F.col("target"), none, F.lit(None).cast("array<string>")).distinct())
    t = t.union(rules.absent.select("source", F.lit(ABSENT), none, none, none, F.lit(None).cast("array<string>")).distinct())
    name = F.regexp_replace("target_file", r"^\.\./", "")
    has = lambda c, x: F.coalesce(F.array_contains(c, F.col(x)), F.lit(False))
    load = (F.col("kind") == MODULE) & (F.contains("static_file", name) | has("wrong", "static_file"))
    call = (F.col("kind") == FUNCTION) & ((F.col("static_lines") == F.col("lines")) | has("alike", "lines"))
    fits = F.coalesce(F.when(F.col("is_load"), load).otherwise(call), F.lit(False))
    is_static = F.col("role") == STATIC
    d = o.join(t, "source", "left").groupBy(o.columns).agg(
        F.max(F.when(is_static, F.col("kind") == UNRESOLVED)).alias("open"), F.max(F.when(is_static, fits)).alias("fits"),
        F.max((F.col("role") == UNSOUND) & (F.col("static_file") == F.col("target"))).alias("unsound"), F.max(F.col("role") == ABSENT).alias("absent"),
    )
    d = d.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    kind = F.when(touches(rules.skipped), "skipped").when(touches(rules.ignored), "ignored")
    kind = kind.when(F.col("fits").isNull() & is_("absent"), "expected_missing_source").when(F.col("fits").isNull(), "missing_source")
    kind = kind.when(F.col("open"), "unresolved").when(F.col("fits") & is_("unsound"), "unexpectedly_sound").when(F.col("fits"), "correct")
    kind = kind.when(is_("unsound"), "known_unsound").when(F.col("is_load"), "missing_load").otherwise("missing_call")
    return d.select("edge", kind.alias("class"), touches(rules.excused).alias("excused"), is_("absent").alias("absent"))


def tallies(observed: DataFrame, static: DataFrame, rules: Rules) -> DataFrame:
    """One row of counts over judged(): tested, ignored, unresolved, correct, unexpectedly_sound, known_unsound, expected_missing_source, present_though_absent, missing_source, missing_load, missing_call, missing_unexcused."""
    d = judged(observed, static, rules)
    n = lambda *kinds: F.count_if(F.col("class").isin(*kinds))
    missing = F.col("class").isin("missing_source", "missing_call")
    return d.agg(
        F.count_if(F.col("class") != "skipped").alias("tested"),
        n("ignored").alias("ignored"),
        n("unresolved").alias("unresolved"),
        n("correct", "unexpectedly_sound").alias("correct"),
        n("unexpectedly_sound").alias("unexpectedly_sound"),
        n("known_unsound").alias("known_unsound"),
        n("expected_missing_source").alias("expected_missing_source"),
        F.count_if(F.col("absent") & ~F.col("class").isin("skipped", "ignored", "expected_missing_source")).alias("present_though_absent"),
        n("missing_source").alias("missing_source"),
        n("missing_load").alias("missing_load"),
        n("missing_call").alias("missing_call"),
        F.count_if(missing & ~F.col("excused")).alias("missing_unexcused"),
    )
