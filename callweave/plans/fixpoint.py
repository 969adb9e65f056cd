"""Least fixpoints of monotone rules over relations, by semi-naive rounds of DataFrame joins."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.session import added, bounded, checkpointed, new_folder, removed, written

Relations = dict[str, DataFrame]
#: A frontier of at most so many rows goes so many steps ahead in one round, not one.
FEW, STEPS = 100_000, 8
#: Where a round begins with more new rows, its relations are derived one after the other: what one shuffles is gone before the next begins.
TOGETHER = 1_000_000


class Known:
    """A relation in the shared folder, a file set for each round: `every` reads them all, `new` those of the last round, `count` of them.

    Rows are told apart by key, all columns unless some are named. What a round derives is written once, and known rows are only looked up
    for it: where that is small, it is broadcast to the files of what is known (Spark goes by the size of its files), and nothing
    known is shuffled. Scans pack small files together, so that the number of partitions follows the rows and not the rounds.
    """

    def __init__(self, base: DataFrame, key: list[str] | None = None):
        self.spark, self.schema, self.parts = base.sparkSession, base.schema, []
        self.key = key or self.schema.names
        self._take(base.distinct())

    def _take(self, rows: DataFrame) -> None:
        folder = new_folder(self.spark)
        self.count = added(rows, folder)
        if self.count or not self.parts:
            self.parts.append(folder)
        else:
            removed(self.spark, folder)
        self.new = self._read([folder]) if self.count else None

    def keep(self, derived: DataFrame) -> bool:
        """Takes in what isn't known yet of derived, if there is any."""
        folder = new_folder(self.spark)
        self.derived = self.count = added(derived.select(self.schema.names).distinct(), folder)
        self.new = None
        if self.count:
            rows = self._read([folder])
            met = self.every.select(self.key).join(rows.select(self.key), self.key)
            self._take(rows.join(met, self.key, "left_anti"))
        removed(self.spark, folder)
        return self.count > 0

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders)

    @property
    def every(self) -> DataFrame:
        return self._read(self.parts)


def fixpoint(base: Relations, step: Callable[[Relations, Relations], Relations], max_rounds: int | None = None, first: Relations | None = None, log: list[dict[str, int]] | None = None) -> Relations:
    """All facts that follow from base. step(all, delta) derives, from all facts and those new in the last round, facts of the same relations.

    first: the rows of base that are new in the first round, where base is closed but for what follows from these; else all are. log gets
    how many different rows each round derives, by relation, known ones among them.

    A round keeps what no round had before: rows are sets, without nulls. Each round's new rows go to the shared folder, so that
    neither lineage nor work grows with the number of rounds. It ends when a round adds nothing, or after max_rounds.
    """
    with bounded(next(iter(base.values())).sparkSession):
        return _rounds(base, step, max_rounds, first, log)


def _rounds(base: Relations, step: Callable[[Relations, Relations], Relations], max_rounds: int | None, first: Relations | None, log: list[dict[str, int]] | None) -> Relations:
    known, rounds = {k: Known(df) for k, df in base.items()}, 0
    if first is not None:
        for k, r in known.items():
            r.new = checkpointed(first[k].select(r.schema.names).distinct()) if k in first else None
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        every = {k: r.every for k, r in known.items()}
        derived = step(every, {k: r.new if r.new is not None else every[k].limit(0) for k, r in known.items()})
        few = sum(r.count for r in known.values() if r.new is not None) <= TOGETHER
        with ThreadPoolExecutor(len(derived) if few else 1) as pool:  # relations are independent within a round
            held = dict(zip(derived, pool.map(lambda kd: known[kd[0]].keep(kd[1]), derived.items()), strict=True))
        if log is not None:
            log.append({k: known[k].derived for k in derived})
        for k in known.keys() - derived.keys():
            known[k].new = None
        if not any(held.values()):
            break
    return {k: r.every for k, r in known.items()}


def reached(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth): nodes that seeds (node) lead to over edges (src, dst), seeds included, with the fewest steps to each.

    A round goes one step from what the last one found, or STEPS steps where that is few rows, so that long thin ways take fewer rounds.
    """
    edges = written(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL"))  # every round joins them
    known = Known(seeds.select("node").where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)), ["node"])
    depth = 0
    while known.count and (max_depth is None or depth < max_depth):
        steps = STEPS if known.count <= FEW else 1
        steps = steps if max_depth is None else min(steps, max_depth - depth)
        # what the last round found, at the depth it has
        ahead, found = known.new.where(F.col("depth") == depth), []
        for k in range(1, steps + 1):
            ahead = ahead.select("node").join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
            found.append(ahead.withColumn("depth", F.lit(depth + k)))
        every = found[0]
        for more in found[1:]:
            every = every.union(more)
        known.keep(every.groupBy("node").agg(F.min("depth").alias("depth")))
        depth += steps
    return known.every


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) for all dst that src leads to in one step or more."""
    edges = checkpointed(edges.select("src", "dst"))
    e = edges.toDF("mid", "dst")
    step = lambda every, delta: {"path": delta["path"].toDF("src", "mid").join(e, "mid").select("src", "dst")}
    return fixpoint({"path": edges}, step)["path"]
