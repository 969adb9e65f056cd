"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callweave.llm import frames
from callweave.session import table, written

WORD = r"[^\x20\x09-\x0D]+"
#: A source's documents are drawn in the order of a seeded hash, which falls into so many ranges: only sums of a range, and the one range where the draw ends, are ordered.
RANGES = 4096
SEED = 20
EPOCHS = 3
#: Sums of ranges up to this number (some 60 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, epochs: int = EPOCHS, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size -> source, source_size, target: one row a source.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the sum of all sizes; none gets over `epochs` times
    its size. With the sources in order of epochs * size / weight, those below the water line are the first k: the line is what
    is left over when they are full, by the weight that is left; the first k that leaves the next source room is it, and any later k gives no higher line.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight.cast("long")).withColumn("room", epochs * F.col("source_size"))
    order = W.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    before = order.rowsBetween(W.unboundedPreceding, -1)
    line = (F.sum("source_size").over(every) - F.coalesce(F.sum("room").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("line", line)
    s = s.withColumn("level", F.max(F.when(F.col("line") * F.col("weight") <= F.col("room"), F.col("line"))).over(every))
    level = F.col("level") * F.col("weight")
    return s.select("source", "source_size", F.coalesce(F.least(level, F.col("room").cast("double")), F.lit(0.0)).alias("target"))


def draws(docs: DataFrame, seed: int = SEED, epochs: int = EPOCHS) -> DataFrame:
    """docs (id, source, size, ...) with source_size, target, whole (repetitions of the whole document), part (words of one more, partial repetition), taken.

    Each document of a source is repeated whole floor(target / source_size) times; of what then remains, the documents in the
    order of a seeded hash of their id take one more whole repetition each until it is used up, and the one at its end takes
    the words that are left: a source's taken words are its target, rounded down. Rows that tie in hash, id and size are alike.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    d = docs.withColumn("draw", digest).withColumn("range", (F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") % RANGES).cast("int"))
    sums = d.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    share = targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), epochs)
    up_to = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    plan = sums.withColumn("below", F.coalesce(F.sum("range_size").over(up_to), F.lit(0)))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    plan = written(plan.join(share, same(plan, share)).select(plan["source"].alias("of"), F.col("range").alias("at"), "range_size", "below", "source_size", "target"))
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan
    d = d.join(plan, d["source"].eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")))
    d = d.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long"))
    d = d.withColumn("more", F.floor("target").cast("long") - F.col("whole") * F.col("source_size"))
    d = d.withColumn("edge", (F.col("below") < F.col("more")) & (F.col("below") + F.col("range_size") > F.col("more")))
    sure = d.where(~F.col("edge")).withColumn("part", F.when(F.col("below") < F.col("more"), F.col("size")).otherwise(0).cast("long"))
    row = W.partitionBy("source", "range").orderBy("draw", F.col("id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, -1)
    edge = d.where("edge").withColumn("so_far", F.col("below") + F.coalesce(F.sum("size").over(row), F.lit(0)))
    edge = edge.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("more") - F.col("so_far"))).cast("long")).drop("so_far")
    return sure.unionByName(edge).withColumn("taken", F.col("whole") * F.col("size") + F.col("part")).drop("draw", "range", "of", "at", "range_size", "below", "more", "edge")


def mix(docs: DataFrame, seed: int = SEED, epochs: int = EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, source, whole, part: one row for each row of docs.

    size: words of the text (null: 0). A null source is a source of its own, the last. A null id draws like an empty one.
    Repeated rows are drawn one by one. Sources without any word have target 0. Extra columns are not read; an empty table
    gives an empty one. The same table gives the same rows, in any layout.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col).cast("string")).alias("size"))
    return draws(d, seed, epochs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "whole", "part")


def mixed(docs: DataFrame, seed: int = SEED, epochs: int = EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself, in docs' columns: each row as often as mix() takes it whole, then once more, cut, if it takes a part.

    A part is the first words of the text with single blanks between them; one of all words is the text as it is. Rows
    without words come as often as their source does whole.
    """
    rows, names = frames.plain(docs, text_col, id=id_col, source=source_col)
    d = draws(rows.withColumn("source", F.col("source").cast("string")).withColumn("size", n_words(F.col("text"))), seed, epochs)
    cut = F.col("part") < F.col("size")
    copies = F.concat(F.array_repeat(F.lit(False), F.col("whole").cast("int")), F.when(F.col("part") > 0, F.array(cut)).otherwise(F.array().cast("array<boolean>")))
    d = d.withColumn("cut", F.explode(copies))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("part").cast("int")), " ")
    whole = F.col(f"c{names.index(text_col)}")
    return frames.restored(d, names, F.when(F.col("cut"), first).otherwise(whole), text_col)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS room FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(room) OVER o, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS DOUBLE) AS line
      FROM w WINDOW o AS (ORDER BY CAST(room AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, max(CASE WHEN line * weight <= room THEN line END) OVER () AS level FROM l),
t AS (SELECT source, source_size, coalesce(least(level * weight, CAST(room AS DOUBLE)), 0.0) AS target FROM v),
p AS (SELECT d.*, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN CAST(floor(floor(t.target) / t.source_size) AS BIGINT) ELSE 0 END AS whole,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ('0x' || substr(draw, 1, 8))::BIGINT % 4096, draw, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CAST(greatest(0, least(size, CAST(floor(target) AS BIGINT) - whole * source_size - so_far)) AS BIGINT) AS part FROM p)
SELECT doc_id, size, source_size, target, CAST(whole * size + part AS BIGINT) AS taken, source, whole, part FROM q
"""
