from pathlib import Path

import pytest

from callweave import session
from callweave.plans.fixpoint import closure, reached


def folders(spark):
    return {p for p in Path(session.shared_dir(spark).removeprefix("file:")).glob("callweave-*")}


def test_rounds_leave_what_is_known_only(spark):
    before = folders(spark)
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "src int, dst int")
    far = reached(edges, spark.createDataFrame([(0,)], "node int"))
    assert far.count() == 13
    # the edges, the seeds, and one set of files for each round that found something
    assert len(folders(spark) - before) == 4
    assert far.rdd.getNumPartitions() <= 8


def test_tables_go_at_the_end(spark):
    before, made = folders(spark), list(session.MADE)
    with session.tables_of(spark):
        rows = closure(spark.createDataFrame([(i, i + 1) for i in range(5)], "src int, dst int")).collect()
        assert folders(spark) - before
    assert len(rows) == 15
    assert folders(spark) == before
    assert made == session.MADE
    with pytest.raises(ZeroDivisionError), session.tables_of(spark):
        session.written(spark.range(3))
        1 / 0  # noqa: B018
    assert folders(spark) == before


def test_rows_are_counted_as_they_are_written(spark):
    at = session.new_folder(spark)
    assert session.added(spark.range(7).toDF("n"), at) == 7
    assert session.added(spark.range(0).toDF("n"), at) == 0
    assert session.added(spark.createDataFrame([], "n long"), at) == 0
    assert spark.read.parquet(at).count() == 7
    session.removed(spark, at)
    session.removed(spark, at)
