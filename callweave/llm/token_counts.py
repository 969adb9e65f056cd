"""Token counts of whole texts, with a whole-token shortcut."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import tokenize, workers
from callweave.session import table


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit): one row for each row of docs, repeated rows included.

    tokenizer: a .model or .json file, as every executor finds it. A null text counts as empty: 0 bytes, 0 tokens. A null id
    stays. Other columns, whatever their names, are not read. An empty table gives an empty one. No shuffle: rows are
    counted where they are read.
    """

    def count(batches):
        known = tokenize.counts(tokenizer)
        for b in batches:
            n = [known.count(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    return workers.mapped(rows, count, f"doc_id {kind}, n_bytes long, n_tokens long", holds=True).withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))
