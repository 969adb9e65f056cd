from callweave.llm import workers
from callweave.llm.workers import _HELD


def test_one_large_thing_at_a_time():
    made = []
    make = lambda k: lambda: made.append(k) or k
    assert [workers.held("a", make("a")), workers.held("a", make("a")), workers.held("b", make("b"))] == ["a", "a", "b"]
    assert made == ["a", "b"] and list(_HELD) == ["b"]
    assert list(workers.tidied(lambda bs: (2 * b for b in bs), iter([1, 2]), holds=True)) == [2, 4]
    assert list(_HELD) == ["b"]
    assert list(workers.tidied(lambda bs: iter(bs), iter([]), holds=False)) == []
    assert not _HELD


def test_a_size_named_by_the_session_stays(spark):
    rows = spark.createDataFrame([(i, "x" * 1000) for i in range(2000)], "id long, text string").coalesce(1)
    sizes = lambda bs: (b for b in bs)
    old = spark.conf.get(workers.BATCH, None)
    try:
        spark.conf.set(workers.BATCH, "1m")
        assert workers.mapped(rows, sizes, "id long, text string").count() == 2000
        assert spark.conf.get(workers.BATCH) == "1m"
        spark.conf.unset(workers.BATCH)
        workers.mapped(rows, sizes, "id long, text string")
        assert spark.conf.get(workers.BATCH) == workers.BATCH_SIZE
    finally:
        spark.conf.set(workers.BATCH, old) if old else spark.conf.unset(workers.BATCH)
