import random

import numpy as np
import pyarrow as pa
import pytest

from callweave.llm import words
from callweave.llm.decontamination import contamination
from callweave.llm.fingerprints import alike
from callweave.llm.near_dups import near_duplicates


def thue_morse(n, a, b):
    """A word of n pieces and its complement: sums of powers over them are equal modulo 2^64 from 1,024 pieces on, whatever the base."""
    while len(a) < n * len(a[:1]) and len(a) < n:
        a, b = a + b, b + a
    return a, b


PAIRS = [thue_morse(4096, "a", "b"), thue_morse(1 << 16, "abcdefgh", "ijklmnop"), thue_morse(1 << 16, "aaaaaaab", "aaaaaaac")]


@pytest.mark.parametrize("pair", PAIRS)
def test_complements_are_different_words(pair):
    w = next(words.chunks(pa.array([f"{pair[0]} {pair[1]} {pair[0]}"])))
    assert w.hash[0] == w.hash[2] != w.hash[1]


def test_equal_words_only_have_equal_hashes():
    rng = random.Random(1)
    some = {"".join(rng.choice("ab\x00é") for _ in range(rng.randint(1, 20))) for _ in range(20000)} | {"a" * k for k in range(1, 300)} | {"a" * k + "\x00" * j for k in range(1, 20) for j in range(1, 20)}
    some = sorted(some)
    text = " ".join(some + some)
    w = next(words.chunks(pa.array(["x", text]), size=1 << 30))
    h = w.hash[1:]
    assert len(h) == 2 * len(some)
    assert (h[: len(some)] == h[len(some) :]).all()
    assert len(np.unique(h)) == len(some)


@pytest.mark.parametrize("pair", PAIRS[:2])
def test_no_link_or_hit_between_complements(spark, pair):
    x, y = pair
    docs = spark.createDataFrame([(1, x), (2, y), (3, f"the {x} one two"), (4, f"the {y} one two")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert {r.doc_id: r.component_id for r in alike(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    items = spark.createDataFrame([(7, x)], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in contamination(docs, items).collect()} == {1: 1, 2: 0, 3: 1, 4: 0}
