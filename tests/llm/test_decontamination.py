import hashlib
import random
import re

import pyarrow as pa

from callweave.llm import words
from callweave.llm.decontamination import Automaton, contamination, decontaminated, op9_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expect(text, items, window=10):
    w = plain(text)
    hit, found = set(), set()
    for name, item in items:
        x = plain(item)
        for i in range(max(1, len(x) - window + 1) if x else 0):
            win = x[i : i + window]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    found.add(str(name))
                    hit |= set(range(j, j + len(win)))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def rows(df):
    return sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def test_random_words(spark):
    """Few words, so that everything overlaps."""
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("a b c D é".split()) for _ in range(n))
    items = [(k, say(rng.choice([0, 2, 4, 6, 9]))) for k in range(8)] + [(99, None)]
    docs = [(k, say(rng.randrange(60))) for k in range(120)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(contamination(d, b, window=4)) == sorted((k, *expect(t, items, 4)) for k, t in docs)


def test_query(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = rows(op9_decontamination(spark, sf))
    assert got == sorted((k, *expect(t, items)) for k, t in docs)
    assert any(r[-1] for r in got)


def test_blocks_of_items(spark, sf):
    from callweave.llm import decontamination as m

    d, b = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    one = m.matches(d.select("doc_id", "text"), b).select("doc_id", "starts", "ends", "items")
    many = m.matches(d.select("doc_id", "text"), b, limit=1500).select("doc_id", "starts", "ends", "items")
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_cutting(spark):
    item = " ".join(f"w{i}" for i in range(30))
    nested = "x1 " + " ".join(f"w{i}" for i in range(5)) + " " + " ".join(f"w{i}" for i in range(12)) + " " + " ".join(f"w{i}" for i in range(5, 30)) + " end"
    docs = [(1, "A clean one.", "s", 1), (2, f"{'before ' * 40}\n{item}! after", "s", 2), (3, item, None, 3), (None, None, "t", 4), (5, nested + " tail" * 90, "t", 5)]
    d = spark.createDataFrame(docs, "doc_id long, text string, items string, n_words int")
    b = spark.createDataFrame([(0, item)], "item_id long, text string")
    out = {r.doc_id: r for r in decontaminated(d, b).collect()}
    assert decontaminated(d, b).columns == d.columns
    assert set(out) == {1, 2, None, 5}
    assert out[1].text == "A clean one." and out[None].text is None and out[None].n_words == 4
    assert out[2].text.startswith("before before") and out[2].text.endswith("\n! after") and "w1" not in out[2].text
    assert not expect(out[5].text, [(0, item)])[-1] and "tail" in out[5].text
    assert decontaminated(d.limit(0), b).count() == 0 and decontaminated(d, b.limit(0)).count() == 5
    assert contamination(d, b.limit(0)).where("contaminated").count() == 0


def test_cutting_with_blocks_of_items(spark, sf):
    d, b = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r.item_id, r.text) for r in b.collect()]
    one = {r.doc_id: r.text for r in decontaminated(d, b).collect()}
    assert sum(t != r.text for r in d.collect() if (t := one.get(r.doc_id))) > 0
    assert not any(expect(t, items)[-1] for t in one.values())
    assert not any(expect(r.text, items)[-1] for r in decontaminated(d, b, limit=4000).collect())


def test_automaton_tracks_the_longest_match():
    a = Automaton([("0", "a b a b c"), ("1", "b c")], window=2)
    w = next(words.chunks(pa.array(["a b c a x b c"]), words.ALNUM))
    assert a.hits(w) == {0: ([(0, 3), (5, 7)], {0, 1})}


def test_null_items_and_odd_rows(spark):
    """Words are counted whatever the items are; null ids, repeated rows and long texts stay."""
    docs = [(1, "one two three"), (None, "one two three"), (2, None), (2, None), (3, "w " * 300_000 + "a b c d e f g h i j")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    item = "A b c d e f g h i j"
    for texts in ([], [None], [None, None, ""], [None, item]):
        b = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item_id long, text string")
        got = sorted(map(str, map(tuple, contamination(d, b).collect())))
        assert got == sorted(str((i, *expect("" if t is None else t[-40:], list(enumerate(texts))))) if i != 3 else str((3, 300_010, *expect(item, list(enumerate(texts)))[1:])) for i, t in docs)
        assert decontaminated(d, b).count() == 5
