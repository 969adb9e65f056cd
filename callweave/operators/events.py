"""Call edges and checks from ordered events: a function entered belongs to the last call made and not yet used up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Events (stream, seq columns, kind, key): call sets the caller, enter uses it up, clear and load drop it; others do nothing.
CALL, ENTER, CLEAR, LOAD = "call", "enter", "clear", "load"


def in_order(*seq: str):
    return W.partitionBy("stream").orderBy(*seq)


def with_caller(events: DataFrame, *seq: str) -> DataFrame:
    """events with caller: the key of the call that is pending before each, or null."""
    before = in_order(*seq).rowsBetween(W.unboundedPreceding, -1)
    state = F.when(F.col("kind").isin(CALL, ENTER, CLEAR, LOAD), F.struct(F.when(F.col("kind") == CALL, F.col("key")).alias("key")))
    return events.withColumn("caller", F.last(state, ignorenulls=True).over(before)["key"])


def call_edges(events: DataFrame, *seq: str) -> DataFrame:
    return with_caller(events, *seq).where((F.col("kind") == ENTER) & F.col("caller").isNotNull())


def first_wins(rows: DataFrame, keys: list[str], *seq: str) -> DataFrame:
    """One row for each value of keys, the first in order."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*seq))).where("__n = 1").drop("__n")


def dynamic_edges(events: DataFrame, *seq: str) -> DataFrame:
    """(source, target, is_load): calls that were entered, and loads with the call pending then, once for each pair."""
    d = with_caller(events, *seq).where(F.col("kind").isin(ENTER, LOAD) & F.col("caller").isNotNull())
    return d.select(F.col("caller").alias("source"), F.col("key").alias("target"), (F.col("kind") == LOAD).alias("is_load")).distinct()


def started(flag: Column, *seq: str) -> Column:
    """Whether flag has been true in this row or before."""
    return F.coalesce(F.max(flag).over(in_order(*seq).rowsBetween(W.unboundedPreceding, W.currentRow)), F.lit(False))


def bracketed(on: Column, off: Column, *seq: str) -> Column:
    """Whether the last of on and off, up to this row, was on."""
    last = F.last(F.when(on, True).when(off, False), ignorenulls=True)
    return F.coalesce(last.over(in_order(*seq).rowsBetween(W.unboundedPreceding, W.currentRow)), F.lit(False))


def hooked(hooks: DataFrame, skipped: str = "graceful-fs", enabled: Column | None = None) -> DataFrame:
    """hooks (stream, seq columns, hook, place, takes_function) -> the same with kind and key, as events have them.

    hook: invoke, builtin, function or require. A call sets the caller unless it stands in a file with `skipped` in its name; a
    built-in function uses it up unless it is given a function; entering a function of such a file does nothing, entering one
    of the run time, whose place begins with (*, uses the caller up without an edge; a load is an edge to a file. Calls and loads while
    enabled is not true do nothing.
    """
    skip, internal, on = F.col("place").contains(skipped), F.col("place").startswith("(*"), F.lit(True) if enabled is None else enabled
    kind = (
        F.when((F.col("hook") == "invoke") & ~skip & on, CALL).when((F.col("hook") == "builtin") & ~F.col("takes_function"), CLEAR)
        .when((F.col("hook") == "function") & ~skip, F.when(internal, CLEAR).otherwise(ENTER)).when((F.col("hook") == "require") & on, LOAD)
    )
    return hooks.withColumn("kind", F.coalesce(kind, F.lit("none"))).withColumn("key", F.col("place"))


def recorded_edges(hooks: DataFrame, *seq: str, on: Column | None = None, off: Column | None = None) -> DataFrame:
    """(stream, source, target, is_load): the edges that hooks, as in hooked(), give, once for each stream; calls by the run time itself make none, but loads do.

    on, off: what begins and ends the load of the main module; calls and loads count from the last `on`, itself included, to the next `off`.
    """
    enabled = None
    if on is not None:
        hooks, enabled = hooks.withColumn("__on", bracketed(on, off if off is not None else F.lit(False), *seq)), F.col("__on")
    d = with_caller(hooked(hooks, enabled=enabled), *seq).where(F.col("kind").isin(ENTER, LOAD) & F.col("caller").isNotNull())
    is_load = F.col("kind") == LOAD
    return d.where(is_load | ~F.col("caller").startswith("(*")).select("stream", F.col("caller").alias("source"), F.col("key").alias("target"), is_load.alias("is_load")).distinct()


def combined(edges: DataFrame, strict: bool = False) -> DataFrame:
    """Edges of many inputs (input, seq, source_file, source_lines, target_file, target_lines, ...), the first of those that have the same lines on both sides; strict: and the same files."""
    keys = ["source_lines", "target_lines"] + (["source_file", "target_file"] if strict else [])
    return first_wins(edges, keys, "input", "seq")


def illegal_loads(events: DataFrame, allowed: DataFrame, start: Column, *seq: str, builtin: Column | None = None) -> DataFrame:
    """Loads, from the first start on, of keys that allowed (key) does not have; nor those for which builtin holds."""
    on = events.withColumn("__on", started(start, *seq)).where(F.col("__on") & (F.col("kind") == LOAD)).drop("__on")
    return (on if builtin is None else on.where(~builtin)).join(allowed, "key", "left_anti")
