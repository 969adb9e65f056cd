"""The queries of the operators in this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callweave.llm import collocations, decontamination, fingerprints, lexical, mixing, near_dups, neighbours, packing, pii, quality, token_counts, url_lists, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_warc_derivatives": warc.op2_warc_derivatives,
    "op3_packing": packing.op3_packing,
    "op4_url_lists": url_lists.op4_url_lists,
    "op5_mixing": mixing.op5_mixing,
    "op6_near_duplicates": near_dups.op6_near_duplicates,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op7_alike": fingerprints.op7_alike,
    "op8_quality": quality.op8_quality,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_personal_data": pii.op10_personal_data,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_nearest_neighbours": neighbours.op12_nearest_neighbours,
    "op13_collocations": collocations.op13_collocations,
}
ORACLE_SQL: dict[str, str] = {
    "op4_url_lists": url_lists.OP4_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op11_lexical_search": lexical.OP11_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
