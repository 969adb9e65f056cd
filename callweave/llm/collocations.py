"""Phrase collocations: a sketch of n-gram counts gives upper bounds, what may be frequent is compiled into automata, and a scan counts it exactly.

Three passes over the texts, none of which sends a text, a word or a phrase through the driver:

1. Each task adds its n-grams (1 to 3 words, by language) to a count-min sketch of fixed size, whose cells stop at the least count asked
   for. The sketches meet range by range; of the sums only a bit a cell is left: has it reached the least count?
2. Each task takes its texts in shards. An n-gram whose cells and whose parts' cells all have their bits is a candidate: cells never count
   too little, so none that is frequent is missed. A shard's own candidates are compiled into an automaton, each between blanks, and the
   automaton runs over the shard's words with one blank between them and a line break between pieces. Matches may overlap.
3. Counts of shards are summed, and what lies below the least count goes. Scores and the phrases inside longer ones are joins from there.

The sketch's size decides only how many candidates fall away early. Beyond what it can tell apart all n-grams are candidates, and the
work is that of exact counting shard by shard: linear in the texts, with memory bound by SHARD.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.llm import words
from callweave.llm.workers import mapped
from callweave.session import table, written

#: Cells of each of the sketch's two rows, and how many go together when sketches meet.
CELLS, RANGE = 1 << 26, 1 << 17
ROWS = 2
#: Bytes of text whose candidates share an automaton; a longer text is taken alone.
SHARD = 16 << 20
#: Candidates in one automaton; a shard that has more is gone over several times. Where the sketch tells nothing apart, a shard has some three million.
NAMES = 1 << 18
LONGEST = 3
#: Bytes that end a piece, and word bytes: all but those and blanks.
BREAKS = b".,;:!?\n\x0b\x0c\r"
WORD = np.ones(256, bool)
WORD[[0x20, 0x09, *BREAKS]] = False
BREAK = np.zeros(256, bool)
BREAK[[*BREAKS]] = True
SEEDS = words.constants(LONGEST, 13)


def pieces(w: words.Words) -> np.ndarray:
    """The number of each word's piece; pieces end at breaks and with their text."""
    return np.searchsorted(np.flatnonzero(BREAK[w.data]), w.start) + w.row


def grams(w: words.Words, lang: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1, 2 and 3 words: (64 bits of each run of words of one piece with its language, the number of the run's first word)."""
    piece, own = pieces(w), words.mix(w.hash ^ lang[w.row])
    out = []
    for k in range(1, LONGEST + 1):
        at = np.flatnonzero(piece[k - 1 :] == piece[: len(piece) - k + 1]).astype(np.int32) if len(piece) >= k else np.zeros(0, np.int32)
        h = np.zeros(len(at), np.uint64)
        for j in range(k):
            h += own[at + j] * SEEDS[j]
        out.append((words.mix(h + np.uint64(k)), at))
    return out


def cells(h: np.ndarray, row: int) -> np.ndarray:
    """Each hash's cell in a row of the sketch."""
    return ((h >> np.uint64(26 * row)) & np.uint64(CELLS - 1)).astype(np.uint32)


def languages(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """The distinct languages, and each row's number among them."""
    d = batch.column(batch.schema.get_field_index("lang")).dictionary_encode()
    return d.dictionary, d.indices.to_numpy(zero_copy_only=False)


def lang_hash(names: pa.Array) -> np.ndarray:
    data, at = words.buffers(names.cast(pa.string()))
    return words.word_hash(data, at[:-1], at[1:])


def _sketched(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketch = np.zeros((ROWS, CELLS), np.uint8)
    for batch in batches:
        names, of = languages(batch)
        lang = lang_hash(names)[of]
        for w in words.chunks(batch.column(batch.schema.get_field_index("text")), WORD, 4 << 20):
            h = np.concatenate([h for h, _ in grams(w, lang[w.first :])])
            for r in range(ROWS):
                at = np.sort(cells(h, r))
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
                count = np.diff(np.append(first, len(at)))
                at = at[first]
                sketch[r, at] = np.minimum(sketch[r, at] + count, least)
    schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])
    for r in range(ROWS):
        for k in range(CELLS // RANGE):
            own = sketch[r, k * RANGE : (k + 1) * RANGE]
            if own.any():
                yield pa.record_batch([pa.array([r * (CELLS // RANGE) + k], pa.int32()), pa.array([pa.compress(own.tobytes(), "zstd", asbytes=True)], pa.binary())], schema=schema)


def _met(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of one range after the other (rows come sorted by range), as bits: which cells reach the least count."""
    schema = pa.schema([("part", pa.int32()), ("bits", pa.binary())])
    part, total = None, np.zeros(RANGE, np.uint32)

    def done():
        return pa.record_batch([pa.array([part], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], schema=schema)

    for batch in batches:
        for p, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if p != part:
                if part is not None:
                    yield done()
                part, total = p, np.zeros(RANGE, np.uint32)
            total += np.frombuffer(pa.decompress(counts.as_buffer(), RANGE, "zstd"), np.uint8)
            np.minimum(total, least, out=total)
    if part is not None:
        yield done()


def frequent_cells(texts: DataFrame, least: int) -> np.ndarray:
    """A bit for each cell of the sketch of texts (lang, text): rows x CELLS / 8 bytes, whatever the texts are."""
    parts = ROWS * CELLS // RANGE
    sketches = mapped(texts, partial(_sketched, least), "part int, counts binary")
    bits = np.zeros((parts, RANGE // 8), np.uint8)
    for r in mapped(sketches.repartition("part").sortWithinPartitions("part"), partial(_met, least), "part int, bits binary").toLocalIterator():
        bits[r.part] = np.frombuffer(r.bits, np.uint8)
    return bits.reshape(ROWS, CELLS // 8)


def held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether all the hashes' cells have their bits."""
    out = np.ones(len(h), bool)
    for r in range(ROWS):
        at = cells(h, r)
        out &= (bits[r, at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8)) & np.uint8(1) != 0
    return out


def candidates(runs: list[tuple[np.ndarray, np.ndarray]], n: int, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the runs over n words, those that may be frequent: their cells are, and so are those of their parts."""
    before = np.ones(n + 1, bool)
    for k, (h, at) in enumerate(runs):
        ok = held(bits, h) & before[at] & (before[at + 1] if k else True)
        before = np.zeros(n + 1, bool)
        before[at[ok]] = True
        yield h[ok], at[ok]


def shard_counts(w: words.Words, lang: np.ndarray, bits: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of texts of one language: candidates, how many words each has, and how often each occurs."""
    names, long, f = zip(([], np.zeros(0, np.int32), np.zeros(0, np.int64)), *slices(w, lang, bits), strict=True)
    return sum(names, []), np.concatenate(long), np.concatenate(f)


def slices(w: words.Words, lang: np.ndarray, bits: np.ndarray) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """What shard_counts() gives, NAMES candidates at a time, each time with an automaton of their own; those that begin alike come together."""
    n = len(w.hash)
    begin, stop, flat = spaced(w)
    raw = flat.tobytes()
    text = raw.decode()
    firsts, longs, wants = [], [], []
    for k, (h, at) in enumerate(candidates(grams(w, lang), n, bits)):
        _, first, count = np.unique(h, return_index=True, return_counts=True)
        firsts.append(at[first])
        longs.append(np.full(len(first), k + 1, np.int32))
        wants.append(count.astype(np.int32))
    start, long, want = np.concatenate(firsts), np.concatenate(longs), np.concatenate(wants)
    del firsts, longs, wants, flat, h, at, first, count
    order = np.argsort(w.hash[start], kind="stable")
    for low in range(0, len(order), NAMES):
        own = order[low : low + NAMES]
        size = long[own]
        names = [raw[a:b].decode() for a, b in zip(begin[start[own]].tolist(), stop[start[own] + size - 1].tolist(), strict=True)]
        found = scanned(names, text)
        if not np.array_equal(found, want[own]):  # two phrases with one hash: name all of these hashes
            every = set()
            runs = grams(w, lang)
            for k, ((h, at), (all_h, all_at)) in enumerate(zip(candidates(runs, n, bits), runs, strict=True)):
                mine = all_h[np.isin(all_at, start[own[size == k + 1]])]
                every |= {(raw[begin[i] : stop[i + k]].decode(), k + 1) for i in at[np.isin(h, mine)].tolist()}
            names, size = [p for p, _ in every], np.array([k for _, k in every], np.int32)
            found = scanned(names, text)
        yield names, size, found


def spaced(w: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each word begins, where it ends, bytes): each word with a blank before it, and a line break before each piece's first."""
    piece = pieces(w)
    opens = np.concatenate([[True], piece[1:] != piece[:-1]])
    size = w.end - w.start
    stop = np.cumsum(size + np.where(opens, 3, 1))  # " \n " or " "
    begin = stop - size
    flat = np.full(stop[-1] + 1, 0x20, np.uint8)
    flat[begin[opens] - 2] = 0x0A
    flat[covered(begin, stop, len(flat))] = w.data[covered(w.start, w.end, len(w.data))]
    return begin, stop, flat


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """For each of n places, whether one of the ranges, of which no two meet, has it."""
    step = np.zeros(n + 1, np.int8)
    step[start] = 1
    step[end] -= 1
    return np.cumsum(step[:-1], dtype=np.int8).view(bool)


def scanned(names: list[str], text: str) -> np.ndarray:
    """How often each name occurs between blanks, overlapping matches included."""
    automaton = ahocorasick.Automaton()
    for i, name in enumerate(names):
        automaton.add_word(f" {name} ", i)
    automaton.make_automaton()
    return np.bincount(np.fromiter((i for _, i in automaton.iter(text)), np.int64), minlength=len(names))


COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64())])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept, size = [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, 4096):
            part = batch.slice(k, 4096)
            more = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if kept and size + more > SHARD:
                yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                kept, size = [], 0
            kept.append(part)
            size += more
    if kept and sum(b.num_rows for b in kept):
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def _counted(bits, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _shards(batches):
        names, of = languages(batch)
        hashes = lang_hash(names)
        texts = batch.column(batch.schema.get_field_index("text"))
        for i, lang in enumerate(names.to_pylist()):
            own = texts.take(pa.array(np.flatnonzero(of == i)))
            for w in words.chunks(own, WORD, SHARD):
                if not len(w.hash):
                    continue
                yield pa.record_batch([pa.array([lang], pa.string()), pa.array([""], pa.string()), pa.array([0], pa.int32()), pa.array([len(w.hash)], pa.int64())], schema=COUNTS)
                for phrases, long, f in slices(w, np.full(len(w.ptr) - 1, hashes[i]), bits.value):
                    yield pa.record_batch([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.string()), pa.array(long, pa.int32()), pa.array(f, pa.int64())], schema=COUNTS)


def phrase_counts(docs: DataFrame, least: int = 10, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, words, f): each run of 1 to 3 words that occurs at least `least` times (up to 255) in its language, and how often; with
    words = 0 and an empty phrase, the number of all words of the language.

    A null language is `und`, a null text has no words; a language without words has no row. Other columns are not looked at.
    """
    if not 1 <= least <= 255:
        raise ValueError("the least count must lie between 1 and 255: a cell of the sketch is a byte")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bits = docs.sparkSession.sparkContext.broadcast(frequent_cells(texts, least))
    counts = mapped(texts, partial(_counted, bits), "lang string, phrase string, words int, f long")
    return counts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0))


def scored(counts: DataFrame, within: int = 50) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the runs of 2 and 3 words in counts, but those inside a longer one that has at least `within` % of their count.

    A cut's score is floor(1000000 a a / (l r)); the cut of the lowest score counts, the earlier one where two are equal. Products are
    decimals of up to 37 digits, so counts stay exact up to 10^14.
    """
    big = "decimal(14,0)"

    def score(left, right):
        return f"CAST((CAST(1000000 AS decimal(7,0)) * (CAST(a AS {big}) * CAST(a AS {big}))) div (CAST({left} AS {big}) * CAST({right} AS {big})) AS long)"

    one, two = (counts.where(F.col("words") == k).select("lang", F.col("phrase").alias(f"p{k}"), F.col("f").alias(f"f{k}")) for k in (1, 2))
    n = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    first, last = F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1)
    long = {k: counts.where(F.col("words") == k).select("lang", "phrase", F.col("f").alias("a")) for k in (2, 3)}

    def asked(rows, side, key, name):
        return rows.withColumn("key", key).join(side.toDF("lang", "key", name), ["lang", "key"]).drop("key")

    pairs = asked(asked(long[2], one, first, "l"), one, last, "r")
    inside = long[3].select("lang", F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase"), F.col("a").alias("f")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    pairs = pairs.join(inside, ["lang", "phrase"], "left").where(f"f IS NULL OR 100 * f < {within} * a").select("lang", "phrase", "a", "l", "r", F.expr(score("l", "r")).alias("score"))
    triples = long[3]
    for side, key, name in ((one, first, "l1"), (two, F.substring_index("phrase", " ", -2), "r1"), (two, F.substring_index("phrase", " ", 2), "l2"), (one, last, "r2")):
        triples = asked(triples, side, key, name)
    triples = triples.withColumns({"s1": F.expr(score("l1", "r1")), "s2": F.expr(score("l2", "r2"))})
    early = F.col("s1") <= F.col("s2")
    triples = triples.select("lang", "phrase", "a", F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    return pairs.unionByName(triples).join(n, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = 10, within: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases by score, count and bytes.

    An empty table gives no row; repeated rows count as often as they come; very long texts are taken whole.
    """
    counts = written(phrase_counts(docs, least, text_col, lang_col))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(counts, within).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 strongest collocations of 2 and 3 words in `documents`."""
    return collocations(table(spark, sf_dir, "documents"))


#: Words numbered over texts with a gap after each piece, so that words that follow each other in one piece have numbers that do.
OP13_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS p, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), numbered AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece
), word AS (SELECT lang, p, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM numbered
), run AS (
  SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM word WINDOW o AS (PARTITION BY p ORDER BY i)
), total AS (SELECT lang, count(*) AS n FROM word GROUP BY 1
), one AS (SELECT lang, w1 AS p1, count(*) AS f FROM run GROUP BY 1, 2
), two AS (SELECT lang, w1, w2, w1 || ' ' || w2 AS p2, count(*) AS f FROM run WHERE w2 IS NOT NULL GROUP BY 1, 2, 3
), three AS (SELECT lang, w1, w2, w3, count(*) AS f FROM run WHERE w2 IS NOT NULL AND w3 IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10
), cut AS (
  SELECT t.lang, p2 AS phrase, 2 AS k, t.f AS a, x.f AS l, y.f AS r, 1 AS c
  FROM two t JOIN one x ON x.lang = t.lang AND x.p1 = w1 JOIN one y ON y.lang = t.lang AND y.p1 = w2 WHERE t.f >= 10
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || w3, 3, t.f, x.f, y.f, 1
  FROM three t JOIN one x ON x.lang = t.lang AND x.p1 = t.w1 JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || w3, 3, t.f, x.f, y.f, 2
  FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.p1 = t.w3
), costed AS (
  SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cut
), best AS (
  SELECT * FROM costed QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), inner_of AS (
  SELECT lang, p, max(f) AS f FROM (
    SELECT lang, w1 || ' ' || w2 AS p, f FROM three UNION ALL SELECT lang, w2 || ' ' || w3, f FROM three) GROUP BY 1, 2
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_of i ON i.lang = b.lang AND i.p = b.phrase WHERE i.f IS NULL OR k = 3 OR 100 * i.f < 50 * b.a
), ranked AS (
  SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
  FROM kept k JOIN total t ON t.lang = k.lang)
SELECT * FROM ranked WHERE rank <= 2000
"""
