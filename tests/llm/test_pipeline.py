import re
from collections import Counter

import corpus_pipeline
import sentencepiece
from callweave.llm.packing import segments
from callweave.llm.quality import quality
from public_tokenizers import path
from tests.llm.test_decontamination import expect

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = BLANK.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(texts):
    """doc_id -> smallest id reachable, over all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    low = {i: i for i in texts}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                low[q] = p
    return {i: find(i) for i in ids}


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs, steps = spark.read.parquet(f"{sf}/documents.parquet"), {}
    columns = docs.columns
    start = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        steps[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in quality(spark.read.parquet(f"{sf}/documents.parquet"), lab).where("kept").collect()}
    first = {r.doc_id: r.text for r in steps["quality"]}
    assert set(first) == good and 0 < len(first) < len(start)

    one = {r.doc_id: r.text for r in steps["near_duplicates"]}
    assert one == {i: first[i] for i, low in groups(first).items() if i == low} and len(one) < len(first)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r.doc_id: r.text for r in steps["decontamination"]}
    for i, t in one.items():
        n, hit, *_, bad = expect(t, items)
        assert (i in clean) if 2 * hit <= n else (i not in clean)
        assert bad or clean[i] == t
    assert not any(expect(t, items)[-1] for t in clean.values())

    size = lambda t: len(BLANK.findall(t))
    mixed = Counter()
    for r in steps["mixing"]:
        mixed[r.source] += size(r.text)
        assert BLANK.findall(clean[r.doc_id])[: size(r.text)] == BLANK.findall(r.text)
    of = Counter()
    for r in steps["decontamination"]:
        of[r.source] += size(r.text)
    names = sorted(of)
    target, left = {}, set(names)
    while True:
        share = (sum(of.values()) - sum(target.values())) / sum(1 + names.index(s) % 3 for s in left)
        full = {s for s in left if share * (1 + names.index(s) % 3) > 3 * of[s]}
        if not full:
            break
        target |= {s: 3 * of[s] for s in full}
        left -= full
    target |= {s: share * (1 + names.index(s) % 3) for s in left}
    assert all(abs(mixed[s] - target[s]) <= 1.001 for s in names)
    assert max(Counter(r.doc_id for r in steps["mixing"]).values()) <= 3

    sp = sentencepiece.SentencePieceProcessor(model_file=str(path("piece_bpe_32k.model")))
    want = Counter(t for r in steps["mixing"] for t in [*sp.encode(r.text), 2])
    assert Counter(t for r in steps["packing"] for _, _, x in segments(r) for t in x) == want


def test_empty_and_odd(spark, sf, tmp_path):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (-5, "the " * 30000, None, None, 1), (-5, "the " * 30000, None, None, 1)], d.schema)
    for k, docs in enumerate((d.limit(0), odd)):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf).write.parquet(str(tmp_path / f"{k}{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}{name}"))


def test_run_writes_each_stage_but_the_last(spark, sf, monkeypatch):
    seen = []

    def stage(spark, docs, sf_dir):
        seen.append(set(docs.inputFiles()))
        return docs.limit(5)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, stage) for n in "abc"])
    assert corpus_pipeline.run(spark, sf).count() == 5
    assert len(seen) == 3 and not (seen[0] & seen[1] or seen[1] & seen[2] or seen[0] & seen[2])
