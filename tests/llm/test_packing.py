import random
from collections import defaultdict

import public_tokenizers
import pytest
import sentencepiece
from callweave.llm.packing import Capacities, best_fit, matrix, op3_packing, packed, positions, segments

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))


def test_capacities_against_a_list():
    rng = random.Random(4)
    for most in (1, 7, 8, 100):
        tree, plain = Capacities(most), []
        for k in range(2000):
            if rng.random() < 0.5:
                left = rng.randint(1, most)
                tree.put(k, left)
                plain.append(left)
            else:
                need = rng.randint(1, most)
                want = min((x for x in plain if x >= need), default=None)
                got = tree.take(need)
                assert (got and got[1]) == want
                if want:
                    plain.remove(want)


def test_best_fit():
    rng = random.Random(5)
    sizes = [rng.choice([1, 3, 50, 99, 100, rng.randint(1, 100)]) for _ in range(3000)]
    rows = best_fit(sizes, 100)
    assert sorted(k for r in rows for k in r) == list(range(len(sizes)))
    assert all(sum(sizes[k] for k in r) <= 100 for r in rows)
    assert len(rows) <= sum(sizes) / 100 * 1.02 + 1
    assert best_fit([], 100) == []


def whole(rows):
    of = defaultdict(list)
    for r in rows:
        assert len(r.ids) == 2 * len(matrix([r])[0]) and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert [x for x, p in enumerate(positions(r)) if p == 0] == r.position_resets
        for d, o, x in segments(r):
            of[d].append((o, x))
    return {d: [t for _, x in sorted(p) for t in x] for d, p in of.items()}


@pytest.mark.parametrize("length,unit", [(2048, 1 << 22), (64, 1000)])
def test_round_trip(spark, sf, length, unit):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packed(d, MODEL, length, unit, eos=2).collect()
    assert matrix(rows).shape == (len(rows), length)
    assert whole(rows) == {r.doc_id: [*sp.encode(r.text), 2] for r in d.collect() if sp.encode(r.text)}
    if unit > 1000:
        assert sum(r.n_tokens for r in rows) > 0.95 * length * (len(rows) - 4)


def test_query(spark, sf):
    out = op3_packing(spark, sf)
    assert out.count() and out.select("row_id").distinct().count() == out.count()


def test_cases(spark):
    d = spark.createDataFrame([(None, "one two", 1), (1, None, 2), (1, "", 2), (2, "same", 3), (2, "same", 3), (3, "x " * 5000, 4)], "doc_id long, text string, ids int")
    rows = packed(d, MODEL, 128).collect()
    assert sorted((x for r in rows for x in r.doc_ids if x != 3), key=str) == [2, 2, None]
    assert len(whole([r for r in rows])[3]) == len(sentencepiece.SentencePieceProcessor(model_file=MODEL).encode("x " * 5000))
    assert packed(d.limit(0), MODEL).count() == 0
