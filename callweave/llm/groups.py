"""Connected groups of linked ids: union-find inside partitions, then minimum labels passed along what is left."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.session import checkpointed

#: Links that one union-find takes at a time.
UNION_ROWS = 200_000


def forest(pairs: pd.DataFrame) -> pd.DataFrame:
    """Union-find over the pairs: each id below its group's smallest one."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in zip(pairs["a"].tolist(), pairs["b"].tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    kept = [(x, find(x)) for x in list(parent)]
    return pd.DataFrame([p for p in kept if p[0] != p[1]], columns=["a", "b"], dtype="int64")


def _contract(frames):
    for pdf in frames:
        for k in range(0, len(pdf), UNION_ROWS):
            yield forest(pdf.iloc[k : k + UNION_ROWS])


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a long, b long): component is the smallest id that links lead to.

    Links in partitions are first contracted to stars by union-find; then labels spread by joins, with a jump to the label's
    own label in each round, until a round changes none. A null end drops the link; loops and repeated links change nothing.
    """
    stars = checkpointed(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").mapInPandas(_contract, "a long, b long"))
    ways = stars.union(stars.select("b", "a")).toDF("u", "v")
    labels = ways.groupBy(F.col("v").alias("id")).agg(F.least(F.min("u"), F.col("id")).alias("component"))
    labels = checkpointed(labels)
    while True:
        near = ways.join(labels, F.col("u") == F.col("id")).groupBy(F.col("v").alias("id")).agg(F.min("component").alias("near"))
        low = labels.join(near, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        up = labels.toDF("of", "next")
        new = checkpointed(low.join(up, F.col("component") == F.col("of")).select("id", F.least("component", "next").alias("component"), "old"))
        if new.where("component <> old").isEmpty():
            return labels
        labels = new.select("id", "component")
