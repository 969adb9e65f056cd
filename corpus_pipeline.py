"""A training corpus from raw documents: STAGES, one after the other, each but the last written and read again, by run() or by whoever runs them.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns of
documents. In every stage columns may be null and an empty table gives an empty one. Null and empty texts go in the first stage;
rows without an id are judged by their text, fold with nothing and mix as one id; of rows that repeat an id the second stage
keeps one; ties are decided by the smallest id, or by a hash of it in the mix.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from callweave.llm import decontamination, mixing, near_dups, packing, quality
from callweave.session import table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the quality classifier rejects."""
    return quality.good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_a_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id."""
    return near_dups.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut; documents that are mostly such passages gone."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share of the mix takes them."""
    return mixing.mixed(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of token ids."""
    return packing.packed(docs, str(public_tokenizers.path("piece_bpe_32k.model")), eos=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_a_group),
    ("decontamination", without_benchmark),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]
#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of token ids from the table documents: every stage but the last written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
