"""Carrying a table's columns, whatever their names, through steps that add columns of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plain(docs: DataFrame, text_col: str, **named: str) -> tuple[DataFrame, list[str]]:
    """(docs as c0, c1, ... with text, not null, in addition, and a copy of each column in named; the columns' names before)."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    d = docs.toDF(*own)
    of = {c: F.col(n) for c, n in zip(docs.columns, own, strict=True)}
    more = {"text": F.coalesce(of[text_col].cast("string"), F.lit(""))} | {k: of[c] for k, c in named.items()}
    return d.select(*own, *[x.alias(k) for k, x in more.items()]), docs.columns


def restored(rows: DataFrame, names: list[str], text=None, text_col: str | None = None) -> DataFrame:
    """The columns of before, text_col replaced by `text` if that is given."""
    return rows.select(*[(text if text is not None and n == text_col else F.col(f"c{i}")).alias(n) for i, n in enumerate(names)])
