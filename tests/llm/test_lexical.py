import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from callweave.llm import lexical

DOCS = "segment long, doc_id long, text string, item_id long, tf string"


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def brute(docs, items, k):
    tf = [(i, Counter(terms(t))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    n, total = len(tf), sum(c.total() for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in tf:
            m = 100 - 90 + 90 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) & set(c))
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def answered(spark, docs, items, k=10, parts=3):
    d = spark.createDataFrame([(1, i, t, 5, "x") for i, t in docs], DOCS).repartition(parts)
    q = spark.createDataFrame([(i, t, 1, 2, "y") for i, t in items], "item_id long, text string, rank int, doc_id long, score string")
    return sorted((tuple(r) for r in lexical.searched(lexical.indexed(d), q, k).collect()), key=str)


def made(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "ouï", "日本", "a1", "x" * 30, *(f"w{i}" for i in range(60))]
    docs = [(i, " ".join(rng.choice(words[: rng.randint(3, len(words))]) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return rng, words, docs


def test_equals_brute_force(spark):
    rng, words, docs = made(1, 300)
    docs += [(1000 + i, docs[0][1]) for i in range(40)]  # ties
    docs += [(7, docs[3][1]), (None, docs[3][1]), (None, "the of"), (2000, None), (2001, ""), (2002, "..."), (2003, "the w1 " * 20000)]
    items = [(i, " ".join(rng.sample(words, 6))) for i in range(30)] + [(1, docs[0][1]), (1, "the"), (None, "w5 w6"), (90, None), (91, "unheard"), (92, "THE-the_the")]
    for k in (1, 10):
        assert answered(spark, docs, items, k) == brute(docs, items, k)


def test_small_segments_and_blocks(spark, monkeypatch):
    """Rows don't depend on how texts are dealt to segments, queries to blocks, or scores to what is held at a time."""
    rng, words, docs = made(2, 200)
    items = [(i, " ".join(rng.sample(words, 5))) for i in range(12)]
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 5)
    whole = answered(spark, docs, items)
    assert whole == brute(docs, items, 10)
    assert [len(b.ids) for b in lexical.blocks(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")] == [5, 5, 2]


def test_bytes_bound_impacts():
    tf, m = np.meshgrid(np.arange(1, 3000, 7), [10, 11, 55, 100, 1000, 10**6, 10**9])
    s = lexical.impact(tf.ravel().astype(np.int64), m.ravel().astype(np.int64))
    byte = (s * lexical.STEPS + lexical.MOST - 1) // lexical.MOST
    assert byte.max() <= 255
    assert (lexical.UPPER[byte] >= s).all()
    assert (lexical.LOWER[byte] <= s).all()


def test_ranges_cover_all_items(monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 10)
    assert list(lexical.ranges(5, 4)) == [(0, 2), (2, 4), (4, 5)]
    assert list(lexical.ranges(2, 100)) == [(0, 1), (1, 2)]


def test_lengths_beyond_64_bits():
    assert lexical.lengths(np.array([10**9]), 10**12, 10**13).tolist() == [10 + 90 * 10**9 * 10**12 // 10**13]


def test_empty_tables(spark):
    for docs, items in (([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")])):
        assert answered(spark, docs, items) == []


def test_row_groups_hold_few_segments(spark):
    """Readers hold a row group unpacked, so it must not grow with what a task reads."""
    docs = spark.range(4).repartition(1).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 600000), x -> concat('w', x * 4 + id)), ' ') AS text")
    index = lexical.indexed(docs)
    groups = [m.row_group(k).num_rows for f in index.segments.inputFiles() for m in [pq.read_metadata(f.removeprefix("file://"))] for k in range(m.num_row_groups)]
    assert groups == [1, 1, 1, 1] and (index.docs, index.terms) == (4, 2_400_000)
