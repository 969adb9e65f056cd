"""Ranked lexical search over an index of two levels.

The index is a table of segments, a row each: the documents of some megabytes of text, their distinct terms, and each term's postings. The
first level holds a posting's impact as one byte, rounded up; the second its exact frequency. A step of a byte is 1/255 of the greatest
impact, so a byte bounds the impact from both sides.

A block of queries (bounded in items and bytes) goes over all segments three times, each time reading the columns it needs:

1. terms and their document counts, for the queries' weights;
2. bytes: each task keeps the k best lower bounds a query, and the k-th best of all tasks is the query's bar;
3. bytes again for upper bounds, and exact frequencies where an upper bound reaches the bar: those documents are scored in whole numbers.

A document below the bar has k better ones, so none is lost, whatever the number of ties. Tasks hold one segment and give k rows a query
at most; nothing is shuffled but those rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.llm import words
from callweave.llm.workers import mapped
from callweave.session import WIDE_ROWS, table, written

#: Bytes and documents of a segment; a longer text is a segment of its own.
SEGMENT, SEGMENT_DOCS = 4 << 20, 4096
#: Whoever reads the index holds a row group unpacked, which is several times as large as it is written.
INDEX_ROWS = WIDE_ROWS | {"parquet.block.size": 4 << 20}
#: Items and bytes of a block of queries; a longer item is a block of its own.
BLOCK_ITEMS, BLOCK_BYTES = 1024, 1 << 20
#: Scores that are held at a time.
CELLS = 1 << 22
#: Every impact lies below; how many steps it is rounded to.
MOST, STEPS = 1_000_000, 255
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

UPPER = np.arange(STEPS + 1, dtype=np.int64) * MOST // STEPS
LOWER = np.concatenate([[0], np.arange(STEPS, dtype=np.int64) * MOST // STEPS + 1])

SEGMENTS = "segment long, docs array<long>, n array<int>, terms array<string>, df array<int>, slot array<int>, tf array<int>, impact binary"


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def lengths(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """Each document's m, of its number of terms, the number of documents and that of all terms; in whole numbers of any size."""
    return np.array([100 - 90 + 90 * x * docs // total for x in n.tolist()], np.int64)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in batches:
        for w in words.chunks(batch.column(1), words.ALNUM):
            docs, terms = docs + int(np.count_nonzero(w.n)), terms + len(w.start)
    yield pa.record_batch([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], ["docs", "terms"])


def postings(w: words.Words) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, each one's number of documents, then for each posting, term by term: the document's row, the frequency)."""
    _, first, term = np.unique(w.hash, return_index=True, return_inverse=True)
    d = len(w.ptr) - 1
    key, tf = np.unique(term.astype(np.int64) * d + w.row, return_counts=True)
    size = w.end[first] - w.start[first]
    data = w.data[np.repeat(w.start[first], size) + words.ragged(size)]
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    names = pa.StringArray.from_buffers(len(first), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data)))
    return names, np.bincount(key // max(d, 1), minlength=len(first)), key % max(d, 1), tf


def _segments(docs: int, total: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = 0
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
    schema = pa.schema(list(zip((c.split()[0] for c in SEGMENTS.split(", ")), kinds, strict=True)))
    for batch in batches:
        for k in range(0, batch.num_rows, SEGMENT_DOCS):
            part = batch.slice(k, SEGMENT_DOCS)
            for w in words.chunks(part.column(1), words.ALNUM, SEGMENT):
                if not len(w.start):
                    continue
                terms, df, slot, tf = postings(w)
                s = impact(tf, lengths(w.n, docs, total)[slot])
                byte = ((s * STEPS + MOST - 1) // MOST).astype(np.uint8)
                ids = part.column(0).slice(w.first, len(w.ptr) - 1)
                lists = [ids, *(pa.array(x.astype(np.int32)) for x in (w.n,)), terms, *(pa.array(x.astype(np.int32)) for x in (df, slot, tf))]
                row = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
                yield pa.record_batch([pa.array([(TaskContext.get().partitionId() << 32) + count]), *row, pa.array([byte.tobytes()], pa.binary())], schema=schema)
                count += 1


@dataclass
class Index:
    """segments: a table of SEGMENTS; docs: documents with a term; terms: all terms with repeats."""

    segments: DataFrame
    docs: int
    terms: int


def indexed(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all documents, written to the shared folder.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased. A null or empty text has
    none, and isn't counted. Every row is a document of its own, those that share an id or have a null one too. Other columns aren't read.
    """
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = mapped(texts, _sizes, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    return Index(written(mapped(texts, partial(_segments, *size), SEGMENTS), **INDEX_ROWS), *size)


@dataclass
class Block:
    """Queries: their ids, their distinct terms, for each term the queries that have it, and its weight."""

    ids: list
    terms: list[str]
    items: list[np.ndarray]
    weight: np.ndarray


def blocks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    """Queries with their distinct terms, some at a time."""
    ids, of, size = [], {}, 0

    def block():
        terms = sorted(of)
        return Block(list(ids), terms, [np.array(of[t]) for t in terms], np.zeros(len(terms), np.int64))

    for r in queries.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).toLocalIterator():
        if ids and (len(ids) >= BLOCK_ITEMS or size + len(r.text) > BLOCK_BYTES):
            yield block()
            ids, of, size = [], {}, 0
        for t in set(TERM.findall(r.text.translate(ASCII_LOWER))):
            of.setdefault(t, []).append(len(ids))
        ids.append(r.id)
        size += len(r.text)
    if of:
        yield block()


@dataclass
class Segment:
    """A row of the index, with the queries' terms that it has: (number in the block, where its postings begin and end)."""

    found: list[tuple[int, int, int]]
    columns: dict

    def array(self, name: str) -> np.ndarray:
        return self.columns[name].values.to_numpy(zero_copy_only=False)

    @staticmethod
    def each(batches: Iterator[pa.RecordBatch], terms: pa.Array) -> Iterator[Segment]:
        for batch in batches:
            for k in range(batch.num_rows):
                c = {n: batch.column(i)[k] for i, n in enumerate(batch.schema.names)}
                place = pc.index_in(c["terms"].values, value_set=terms)
                at = np.concatenate([[0], np.cumsum(c["df"].values.to_numpy(zero_copy_only=False).astype(np.int64))])
                here = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
                number = place.take(pa.array(here)).to_numpy(zero_copy_only=False)
                yield Segment(list(zip(number.tolist(), at[here].tolist(), at[here + 1].tolist(), strict=True)), c)


def _frequencies(block, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(len(block.value.terms), np.int64)
    for s in Segment.each(batches, pa.array(block.value.terms, pa.string())):
        for t, a, b in s.found:
            df[t] += b - a
    has = np.flatnonzero(df)
    yield pa.record_batch([pa.array(has.astype(np.int32)), pa.array(df[has])], ["term", "df"])


def ranges(items: int, docs: int) -> Iterator[tuple[int, int]]:
    step = max(1, CELLS // max(docs, 1))
    yield from ((k, min(k + step, items)) for k in range(0, items, step))


def summed(block: Block, s: Segment, low: int, high: int, value, docs: int, place=None) -> np.ndarray:
    """Sums over terms, of weight by value(a, b) for postings a to b: a row for each query from low to high, a column for each document.
    place: a column for each document's row, -1 for those left out."""
    out, slot = np.zeros((high - low, docs), np.int64), s.array("slot")
    for t, a, b in s.found:
        rows = block.items[t]
        rows = rows[(rows >= low) & (rows < high)] - low
        if not len(rows):
            continue
        cols, got = slot[a:b], value(a, b)
        if place is not None:
            cols = place[cols]
            got, cols = got[cols >= 0], cols[cols >= 0]
        out[rows[:, None], cols] += block.weight[t] * got
    return out


def _bars(block, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    b = block.value
    best = np.zeros((len(b.ids), k), np.int64)
    for s in Segment.each(batches, pa.array(b.terms, pa.string())):
        byte, docs = np.frombuffer(s.columns["impact"].as_buffer(), np.uint8), s.columns["size"].as_py()
        for low, high in ranges(len(b.ids), docs):
            bound = summed(b, s, low, high, lambda x, y, byte=byte: LOWER[byte[x:y]], docs)
            best[low:high] = np.partition(np.concatenate([best[low:high], bound], axis=1), docs, axis=1)[:, docs:]
    item, column = np.nonzero(best)
    yield pa.record_batch([pa.array(item.astype(np.int32)), pa.array(best[item, column])], ["item", "lower"])


RANKED = pa.schema([("item", pa.int32()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _rescored(block, bar, size: tuple[int, int], k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    b = block.value
    items, ids, scores = (np.zeros(0, np.int64) for _ in range(3))
    blank = np.zeros(0, bool)  # whether the id is null
    for s in Segment.each(batches, pa.array(b.terms, pa.string())):
        byte, tf, n = np.frombuffer(s.columns["impact"].as_buffer(), np.uint8), s.array("tf").astype(np.int64), s.array("n")
        slot, docs, m = s.array("slot"), len(n), None
        for low, high in ranges(len(b.ids), docs):
            upper = summed(b, s, low, high, lambda x, y, byte=byte: UPPER[byte[x:y]], docs)
            reach = (upper > 0) & (upper >= bar.value[low:high, None])
            cols = np.flatnonzero(reach.any(axis=0))
            if not len(cols):
                continue
            m = lengths(n, *size) if m is None else m
            place = np.full(docs, -1)
            place[cols] = np.arange(len(cols))
            exact = summed(b, s, low, high, lambda x, y, m=m, tf=tf, slot=slot: impact(tf[x:y], m[slot[x:y]]), len(cols), place)
            item, col = np.nonzero(reach[:, cols] & (exact > 0))
            own = s.columns["docs"].values
            null = own.is_null().to_numpy(zero_copy_only=False)[cols[col]]
            doc = own.fill_null(0).to_numpy(zero_copy_only=False)[cols[col]]
            items, ids, scores, blank = np.append(items, item + low), np.append(ids, doc), np.append(scores, exact[item, col]), np.append(blank, null)
            if len(items) > 4 * k * len(b.ids):
                keep = firsts(items, scores, blank, ids, k)
                items, ids, scores, blank = items[keep], ids[keep], scores[keep], blank[keep]
    keep = firsts(items, scores, blank, ids, k)
    items, ids, scores, blank = items[keep], ids[keep], scores[keep], blank[keep]
    yield pa.record_batch([pa.array(items.astype(np.int32)), pa.array([b.ids[i] for i in items.tolist()], pa.int64()), pa.array(ids, mask=blank), pa.array(scores)], schema=RANKED)


def firsts(items: np.ndarray, scores: np.ndarray, blank: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The rows of each item's k first: highest scores, then smallest ids, null ids last."""
    order = np.lexsort((ids, blank, -scores, items))
    own = items[order]
    first = np.searchsorted(own, own, "left")
    return order[np.arange(len(order)) - first < k]


def searched(index: Index, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id long, rank int, doc_id long, score long): the k documents of the highest score above 0 for each query (all, if fewer).

    Equal scores go by ascending doc_id, null ids last. Each row of queries is answered on its own, those that share an id too; a query
    without a known term, a null one say, has no rows.
    """
    spark = queries.sparkSession
    found = []
    for b in blocks(queries, id_col, text_col) if index.docs else ():
        sent = spark.sparkContext.broadcast(b)
        for r in mapped(index.segments.select("terms", "df"), partial(_frequencies, sent), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
            b.weight[r.term] = math.floor(1000 * math.log((2 * index.docs + 2) / (2 * r.df + 1)))
        sent.unpersist()
        sent = spark.sparkContext.broadcast(b)
        lower = mapped(index.segments.select("terms", "df", "slot", "impact", F.size("docs").alias("size")), partial(_bars, sent, k), "item int, lower long")
        best = lower.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("lower")))).where(F.col("place") <= k)
        bar = np.zeros(len(b.ids), np.int64)
        for r in best.where(F.col("place") == k).toLocalIterator():
            bar[r.item] = r.lower
        exact = mapped(index.segments.select("docs", "n", "terms", "df", "slot", "tf", "impact"), partial(_rescored, sent, spark.sparkContext.broadcast(bar), (index.docs, index.terms), k), "item int, item_id long, doc_id long, score long")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ranked = exact.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        found.append(written(ranked))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of all `documents` that rank highest for each `benchmark` item."""
    return searched(indexed(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH term AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents
), posting AS (SELECT doc_id, t, count(*) AS tf FROM term GROUP BY 1, 2
), doc AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM posting GROUP BY 1
), whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM doc
), sized AS (SELECT doc_id, 100 - 90 + ((90 * n * docs) // terms) AS m FROM doc, whole
), weighed AS (
  SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM posting, whole GROUP BY 1
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN posting USING (t) JOIN weighed USING (t) JOIN sized USING (doc_id) GROUP BY 1, 2
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""
