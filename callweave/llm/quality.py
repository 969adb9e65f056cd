"""Quality by perplexity under a language model of trusted text, with a limit for each language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callweave.llm import frames, language_model
from callweave.session import table, written

#: One trusted document in FOLDS is held out of the model and sets the limits.
FOLDS = 5
#: Share of held-out trusted documents within the limit.
QUANTILE = 0.995
#: Of n held-out documents the limit lies 1 + WIDER / n times as far from the middle as the quantile does: few don't show how far good ones reach.
WIDER = 3.0
#: Ids, or limits, up to this number (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def small(df: DataFrame) -> DataFrame:
    """df, which is a written table of narrow rows: broadcast if it has at most BROADCAST_ROWS."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def trusted(labels: DataFrame) -> DataFrame:
    """(id, held): documents that every label of theirs calls good and none toxic, and whether they are held out."""
    own = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(1))).alias("t"))
    return own.where("q = 1 AND t = 0").select("id", (F.pmod(F.xxhash64("id"), F.lit(FOLDS)) == 0).alias("held"))


def quantile(rows: DataFrame, value: Column, q: float, step: float) -> DataFrame:
    """rows (key, ...) -> key, n, value: the smallest multiple of `step` that is not below a share q of the key's values. Only one count for each multiple goes to a window."""
    bins = rows.groupBy("key", F.ceil(value / step).alias("bin")).agg(F.count("*").alias("c"))
    w = W.partitionBy("key")
    run = bins.withColumn("n", F.sum("c").over(w)).withColumn("upto", F.sum("c").over(w.orderBy("bin")))
    return run.where(F.col("upto") >= q * F.col("n")).groupBy("key").agg(F.first("n").alias("n"), (F.min("bin") * step).alias("value"))


def excess(middle: Column) -> Column:
    """How far a document's mean lies above its language's middle, in units that don't depend on its length: means of short texts scatter more."""
    return (F.col("nll") - middle) * F.sqrt("n_chars")


def limits(held: DataFrame, q: float = QUANTILE, wider: float = WIDER) -> DataFrame:
    """held (lang, nll, n_chars, worst) -> lang, middle, most, stretch: one row for each language, and one, lang null, for all documents together."""
    both = written(held.where("nll IS NOT NULL").select(F.explode(F.array_distinct(F.array("lang", F.lit(None)))).alias("key"), "nll", "n_chars", "worst"))
    middles = written(quantile(both, F.col("nll"), 0.5, 0.001).select(F.col("key").alias("of"), "n", F.col("value").alias("middle")))
    far = quantile(both.join(small(middles), F.col("key").eqNullSafe(F.col("of"))), excess(F.col("middle")), q, 0.01).select("key", F.col("value").alias("far"))
    usual = quantile(both, F.col("worst"), 0.5, 0.01).select("key", F.col("value").alias("usual"))
    least = quantile(both, F.col("worst"), q, 0.01).select("key", F.col("value").alias("least"))
    out = middles
    for part in (far, usual, least):
        out = out.join(part, F.col("of").eqNullSafe(F.col("key"))).drop("key")
    factor = 1 + F.lit(wider) / F.col("n")
    return written(out.select(F.col("of").alias("lang"), "middle", (F.col("far") * factor).alias("most"), (F.col("usual") + (F.col("least") - F.col("usual")) * factor).alias("stretch")))


def judged(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", order: int = language_model.ORDER, q: float = QUANTILE, whole: bool = True) -> tuple[DataFrame, list[str]]:
    """docs' columns as c0, c1, ... (the text as text, not null) with n_chars, nll, worst, middle, most, stretch, kept, and docs' names (see frames); only id and lang of them unless whole. Texts are read once, and moved to trusted ids only if those are too many to broadcast."""
    rows, names = frames.plain(docs, text_col, id=id_col, lang=lang_col)
    rows = rows.drop(f"c{names.index(text_col)}") if whole else rows.select("id", "lang", "text")  # `text` is the same but for nulls
    ids = small(written(trusted(labels))).withColumnRenamed("id", "own")
    rows = rows.withColumn("lang", F.col("lang").cast("string")).join(ids, F.col("id") == F.col("own"), "left").drop("own")
    rows = rows.withColumn("trained", F.coalesce(~F.col("held"), F.lit(False))).withColumn("held", F.coalesce("held", F.lit(False)))
    d = written(language_model.scored(rows, order, keep_text=whole))
    limit = limits(d.where("held"), q)
    every = limit.where("lang IS NULL").first()
    at = small(limit.where("lang IS NOT NULL")).toDF("of", "m", "t", "s")
    d = d.join(at, F.col("lang") == F.col("of"), "left")
    for own, name in (("m", "middle"), ("t", "most"), ("s", "stretch")):
        d = d.withColumn(name, F.coalesce(own, F.lit(every and every[name]).cast("double")))
    kept = F.when(F.col("nll").isNull(), False).otherwise(F.coalesce((excess(F.col("middle")) <= F.col("most")) & (F.col("worst") <= F.col("stretch")), F.lit(True)))
    return d.withColumn("kept", kept), names


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, lang, n_chars, perplexity (of a code point), limit, kept: one row for each row of docs.

    limit: the perplexity up to which a document of this language and length is kept; 0 where its worst stretch of 8 code
    points rules it out, whatever the perplexity of the whole. The model is an interpolated modified Kneser-Ney one of code
    points, trained on four fifths of all documents that labels trust; the limits are quantiles over the last fifth, by
    language, a little wider where a language has few; a language without any, or null, takes those of all languages. Empty and
    null texts have no perplexity and are not kept. Without trusted documents every document with text is kept. Rows without an
    id are never trusted, but judged; repeated rows are judged alike; labels that repeat an id must all agree; extra columns are
    not read; an empty table gives an empty one.
    """
    d, _ = judged(docs, labels, whole=False, **options)
    limit = F.exp(F.col("middle") + F.col("most") / F.sqrt(F.greatest(F.col("n_chars"), F.lit(1))))
    limit = F.when(F.col("worst") > F.col("stretch"), 0.0).otherwise(limit)
    return d.select(F.col("id").alias("doc_id"), "lang", "n_chars", F.exp("nll").alias("perplexity"), limit.alias("limit"), "kept")


def good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that quality() keeps, in docs' columns."""
    d, names = judged(docs, labels, **options)
    return frames.restored(d.where("kept"), names, F.col("text"), options.get("text_col", "text"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
