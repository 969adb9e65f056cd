import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from callweave.llm import language_model as lm
from callweave.llm import quality as q
from callweave.llm.quality import good, op8_quality, quality


def plain_model(texts, order):
    """Kneser-Ney over dictionaries: p(code point | context) as a function, and a text's n-grams."""
    say = lambda t: [tuple(x) for x in zip(*[("\n" * (order - 1) + t)[j:] for j in range(order)], strict=False)]
    tables = {order: Counter(g for t in texts for g in say(t))}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    off, of = {}, defaultdict(list)
    for k, t in tables.items():
        n = [sum(x == j for x in t.values()) for j in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        off[k] = [max(0, min(j, j - (j + 1) * y * n[j] / n[j - 1])) if all(n[:3]) else 0.5 * j for j in (1, 2, 3)]
        for g, c in t.items():
            of[g[:-1]].append(c)
    memo = {(): 1 / lm.ALPHABET}

    def p(g):
        if g not in memo:
            k, cs, c = len(g), of.get(g[:-1], []), tables[len(g)].get(g, 0)
            own = c - off[k][min(c, 3) - 1] if c else 0
            memo[g] = (own + sum(off[k][min(x, 3) - 1] for x in cs) * p(g[1:])) / sum(cs) if cs else p(g[1:])
        return memo[g]

    return p, say


def plain_scores(p, say, text, size=lm.STRETCH):
    cost = [-math.log(p(g)) for g in say(text)]
    if not cost:
        return None, None
    n = min(size, len(cost))
    return sum(cost) / len(cost), max(sum(cost[i : i + n]) / n for i in range(len(cost) - n + 1))


def test_scores_equal_dictionaries(spark, sf):
    texts = [r.text[:300] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(12).collect()] + ["", "x", "Я\U0001f600é"]
    new = [*texts[:3], "Zz 99 ßé\n\n~~ unseen \u4e2d", "", "\U0001f600" * 20]
    rows = [(t, True) for t in texts] + [(t, False) for t in new]
    for order, size in ((2, 1 << 20), (4, 1 << 20), (3, 1)):
        p, say = plain_model(texts, order)
        for r in lm.scored(spark.createDataFrame(rows, "text string, trained boolean"), order, size=size).collect():
            nll, worst = plain_scores(p, say, r.text)
            assert r.n_chars == len(r.text)
            assert (r.nll, r.worst) == (None, None) if nll is None else abs(r.nll - nll) < 1e-4 and abs(r.worst - worst) < 1e-4


def plain_kept(rows, trained, held):
    """What is kept of rows (id, text, lang), by dictionaries."""
    p, say = plain_model([t for i, t, _ in rows if i in trained], lm.ORDER)
    at = lambda values, share, step: min(b for b in (math.ceil(v / step) for v in values) if sum(math.ceil(v / step) <= b for v in values) >= share * len(values)) * step
    score = [(i, lang, len(t), *plain_scores(p, say, t)) for i, t, lang in rows]
    limits = {}
    for key in {lang for i, lang, *_ in score if i in held} | {None}:
        own = [(n, x, w) for i, lang, n, x, w in score if i in held and x is not None and key in (None, lang)]
        middle = at([x for _, x, _ in own], 0.5, 0.001)
        wide = 1 + q.WIDER / len(own)
        far = at([(x - middle) * n**0.5 for n, x, _ in own], q.QUANTILE, 0.01)
        usual, least = (at([w for _, _, w in own], s, 0.01) for s in (0.5, q.QUANTILE))
        limits[key] = middle, far * wide, usual + (least - usual) * wide
    out = {}
    for i, lang, n, x, w in score:
        middle, most, stretch = limits.get(lang, limits[None])
        out[i] = x is not None and (x - middle) * n**0.5 <= most and w <= stretch
    return out


def test_kept_equals_brute_force(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.withColumn("text", q.F.left("text", q.F.lit(1500)))
    own = {r.id: r.held for r in q.trusted(labels).collect()}
    want = plain_kept([(r.doc_id, r.text, r.lang) for r in docs.collect()], {i for i, h in own.items() if not h}, {i for i, h in own.items() if h})
    got = {r.doc_id: r.kept for r in quality(docs, labels).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_noise_in_another_script(spark):
    rng = random.Random(3)
    letters = "абвгдежзийклмнопрстуфхцчшщыьэюя"
    say = lambda n, pick: " ".join(pick() for _ in range(n))
    known = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(400)]
    real = [(i, say(60, lambda: rng.choice(known)), "ru", 1) for i in range(300)]
    noise = [(1000 + i, say(60, lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))), "ru", 0) for i in range(20)]
    docs = spark.createDataFrame(real + noise, "doc_id long, text string, lang string, ok int")
    labels = docs.where("doc_id < 280").selectExpr("doc_id", "ok AS quality", "0 AS toxic")
    kept = {r.doc_id: r.kept for r in quality(docs, labels).collect()}
    assert not any(kept[1000 + i] for i in range(20)) and sum(kept[i] for i in range(300)) >= 297


def test_ties_and_long_texts(spark):
    """Texts of equal scores are all kept, with the limit at their score; a long text is scored whole."""
    rows = [(i, "same words again", "en") for i in range(40)] + [(100, "same words again " * 60_000, "en"), (101, "same words again " * 60_000 + "\u4e2d\u6587" * 40, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.where("doc_id < 100").selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    out = {r.doc_id: r for r in quality(docs, labels).collect()}
    assert all(out[i].kept for i in range(40)) and not out[101].kept and out[101].limit == 0
    assert out[100].n_chars == 17 * 60_000


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = op8_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    clean = [r.kept for r in out if r.quality == 1 and r.toxic == 0]
    junk = [r.kept for r in out if r.quality == 0]
    assert sum(clean) / len(clean) > 0.97 and sum(junk) / len(junk) < 0.1
    assert all(r.kept == (r.perplexity <= r.limit) for r in out if abs(r.perplexity - r.limit) > 1e-9)


def test_cases(spark, sf):
    d, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(None, None, None, "s", 0), (-1, "", "en", "s", 0), (-2, "~{}^`|" * 3000, "xx", None, 0), (-2, "~{}^`|" * 3000, "xx", None, 0)], d.schema)
    both = d.union(odd).withColumn("kept", d.n_chars).withColumn("c0", d.n_chars)
    labels = lab.union(spark.createDataFrame([(None, 1, 0), (5, None, None)], lab.schema))
    out = quality(both, labels).collect()
    assert len(out) == d.count() + 4
    assert [r.kept for r in out if r.doc_id is None or r.doc_id < 0] == [False] * 4
    kept = good(both, labels)
    assert kept.columns == both.columns and kept.where("doc_id < 0").count() == 0 and kept.count() > d.count() / 2
    assert quality(d.limit(0), lab).count() == 0
    assert quality(both, lab.limit(0)).where("kept").count() == d.count() + 2


def test_grams_over_many_chunks(monkeypatch):
    monkeypatch.setattr(lm.words, "CHUNK", 40)
    rng = random.Random(8)
    texts = ["".join(rng.choice("abé中") for _ in range(rng.randrange(30))) for _ in range(50)]
    trained = np.array([rng.random() < 0.5 for _ in texts])
    every, own = Counter(), Counter()
    for t, use in zip(texts, trained, strict=True):
        for i in range(len(t)):
            g = ("\n\n" + t)[i : i + 3]
            every[g] += 1
            own[g] += use
    rows = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(trained)], ["text", "trained"])
    shard = lm.Shard(rows.schema, 3)
    for k in range(0, 50, 20):
        shard.add(rows.slice(k, 20))
    out = shard.closed(7).to_pylist()[0]
    assert len(out["grams"]) == len(every) and dict(zip(out["grams"], out["counts"], strict=True)) == dict(own)


def test_worst_stretch():
    rng = np.random.default_rng(5)
    sizes = [0, 3, lm.STRETCH, lm.STRETCH + 1, 200, 0, 90, lm.STRETCH - 1, 0]
    at = np.concatenate([[0], np.cumsum(sizes)])
    x = rng.random(at[-1])
    got = lm.worst(np.concatenate([[0.0], np.cumsum(x)]), at)
    for lo, hi, g in zip(at[:-1], at[1:], got, strict=True):
        n = min(lm.STRETCH, hi - lo)
        assert abs(g - max((x[i : i + n].mean() for i in range(lo, hi - n + 1) if n), default=0)) < 1e-9


def test_kept_by_label(spark):
    """Whole labels, where limits go by language."""
    sf = "/root/testdata/sf0.1"
    out = op8_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    kept = {k: [r.kept for r in out if (r.quality, r.toxic) == k] for k in ((1, 0), (1, 1), (0, 0), (0, 1))}
    share = {k: sum(v) / len(v) for k, v in kept.items()}
    assert share[1, 0] > 0.98 and share[1, 1] < 0.45 and share[0, 0] < 0.05 and share[0, 1] < 0.05
