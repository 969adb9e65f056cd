import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from callweave.llm import collocations, words

SCHEMA = "doc_id long, text string, lang string, words int, f long, phrase string"


def brute(rows, least, within, top):
    count, n, inside = defaultdict(Counter), Counter(), defaultdict(dict)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                count[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in count.items():
        often = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        for p, a in often.items():
            for part in (p[:2], p[1:]):
                if len(p) == 3:
                    inside[lang][part] = max(inside[lang].get(part, 0), a)
        rows_ = []
        for p, a in often.items():
            if len(p) == 2 and 100 * inside[lang].get(p, 0) >= within * a:
                continue
            s, _, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, k) for k in range(1, len(p)))
            rows_.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for r, (s, a, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, r, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["the", "The", "of", "ouï", "日本", "a", "bb", "x" * 40, "new", "york", " "]
    seps = [" ", " ", "  ", "\t", ". ", ", ", "\n", "\r\n", ":", "\x0b"]
    rows = []
    for _ in range(300):
        words_ = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        rows.append(("".join(w + rng.choice(seps) for w in words_), rng.choice(["en", "fr", None, "und"])))
    rows += [(None, "en"), ("", "de"), (" . ", None), ("new york city " * 5000, "en"), ("new york city " * 3, "only")]
    rows += rows[:50]
    df = spark.createDataFrame([(i, t, lang, 1, 2, "p") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(5)
    for least, within, top in ((10, 50, 2000), (3, 90, 7)):
        got = sorted(tuple(r) for r in collocations.collocations(df, least, within, top).collect())
        assert got == brute(rows, least, within, top)


def test_empty_table(spark):
    got = collocations.collocations(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert got.collect() == []


def test_full_sketch_only_costs(spark, monkeypatch):
    """With every bit set all n-grams are candidates, and the rows are the same."""
    rows = [("a b c. a b d " * 6, "en"), ("b c " * 11, "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(collocations, "frequent_cells", lambda texts, least: np.full((collocations.ROWS, collocations.CELLS // 8), 255, np.uint8))
    assert sorted(tuple(r) for r in collocations.collocations(df).collect()) == brute(rows, 10, 50, 2000)


def test_one_hash_of_two_phrases(monkeypatch):
    """Counting by names sees what hashes hide."""
    import pyarrow as pa

    w = next(words.chunks(pa.array(["a b. c d. a b"]), collocations.WORD))
    every = collocations.grams(w, np.zeros(1, np.uint64))
    monkeypatch.setattr(collocations, "grams", lambda w, lang: [(np.zeros_like(h), at) for h, at in every])
    names, long, f = collocations.shard_counts(w, np.zeros(1, np.uint64), np.full((collocations.ROWS, collocations.CELLS // 8), 255, np.uint8))
    assert dict(zip(names, f.tolist(), strict=True)) == {"a": 2, "b": 2, "c": 1, "d": 1, "a b": 2, "c d": 1}


def test_large_counts_are_exact(spark):
    counts = spark.createDataFrame([("en", "a b", 2, 9_999_999_999_999), ("en", "a", 1, 99_999_999_999_999), ("en", "b", 1, 99_999_999_999_989), ("en", "", 0, 10**15)], "lang string, phrase string, words int, f long")
    (r,) = collocations.scored(counts).collect()
    assert r.score == 1000000 * 9_999_999_999_999**2 // (99_999_999_999_999 * 99_999_999_999_989)


def test_least_is_bounded(spark):
    with pytest.raises(ValueError, match="255"):
        collocations.phrase_counts(spark.createDataFrame([("a", "en")], "text string, lang string"), 256)


def test_few_candidates_share_an_automaton(monkeypatch):
    """Of a shard whose n-grams are all candidates, few are held at a time; all are counted, those with one hash too."""
    import pyarrow as pa

    rng = random.Random(5)
    text = " ".join(rng.choice(["a", "b", "ouï", "日本", "c.", "d,", "e"]) for _ in range(400))
    w = next(words.chunks(pa.array([text, "", "a b", "b"]), collocations.WORD))
    bits, sizes = np.full((collocations.ROWS, collocations.CELLS // 8), 255, np.uint8), []
    scanned, grams = collocations.scanned, collocations.grams
    monkeypatch.setattr(collocations, "scanned", lambda names, text: sizes.append(len(names)) or scanned(names, text))
    want = Counter()
    for piece in [p.split() for t in (text, "a b", "b") for p in re.split("[.,]", t)]:
        want.update(" ".join(piece[i : i + k]) for k in (1, 2, 3) for i in range(len(piece) - k + 1))
    monkeypatch.setattr(collocations, "NAMES", 16)
    for fold in (0, 48, 62):  # bits of hashes that are dropped: the more, the more phrases have one hash
        monkeypatch.setattr(collocations, "grams", lambda w, lang, fold=fold: [(h >> np.uint64(fold), at) for h, at in grams(w, lang)])
        names, long, f = collocations.shard_counts(w, np.zeros(len(w.ptr) - 1, np.uint64), bits)
        assert len(names) == len(want) and dict(zip(names, f.tolist(), strict=True)) == want
        assert [x.count(" ") + 1 for x in names] == long.tolist()
        assert fold or max(sizes) == 16
