"""Approximate nearest neighbours by learned partitions.

1. Equal vectors become one row with its k + 1 smallest ids, so that copies, however many, are searched once.
2. A sample of at most SAMPLE vectors (chosen by a hash of their ids) gives a graph of nearest neighbours. It is cut into balanced parts:
   bisections, then moves of vertices to the part that holds most of their neighbours, while there is room.
3. A softmax classifier learns which parts a vector's neighbours lie in. How many parts a query is sent to is read off sampled vectors
   that it wasn't trained on: as many as hold RECALL of their neighbours.
4. Every vector goes to its most probable part, every query to its most probable ones. Inside a part blocks of vectors meet blocks of
   queries, of a bounded size whatever the part's is; scores are doubles of the vectors as given.

A query's sampled neighbours take part as found; the last of them bounds from below what others must score, so the number of rows that
leave a block follows k and not the block. Only the sample passes through the driver; parts are sqrt(n) / 2 up to PARTS.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.llm.workers import mapped
from callweave.session import table, written

#: Vectors that the graph is made of, at most; parts, at most; neighbours of a vertex.
SAMPLE, PARTS, DEGREE = 8192, 512, 20
#: Of the sample's held-out vectors' neighbours, the share that must lie in the parts a query is sent to.
RECALL = 0.95
#: Bytes of a block of vectors or queries, and rows.
BLOCK_BYTES, BLOCK_ROWS = 2 << 20, 4096


def bisected(x: np.ndarray, parts: int) -> np.ndarray:
    """A part for each row, all of one size or nearly: halves along the direction of the greatest spread, again and again."""
    out = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), parts, 0)]
    while todo:
        rows, p, base = todo.pop()
        if p == 1 or not len(rows):
            out[rows] = base
            continue
        c = x[rows] - x[rows].mean(axis=0)
        way = c[np.argmax((c**2).sum(axis=1))]
        for _ in range(10):
            way = c.T @ (c @ way)
            way /= np.linalg.norm(way) + 1e-300
        order, cut = np.argsort(c @ way, kind="stable"), len(rows) * (p // 2) // p
        todo += [(rows[order[:cut]], p // 2, base), (rows[order[cut:]], p - p // 2, base + p // 2)]
    return out


def graph(x: np.ndarray, degree: int) -> np.ndarray:
    """Each row's neighbours by inner product, itself left out."""
    out = np.empty((len(x), degree), np.int64)
    for k in range(0, len(x), 1024):
        s = x[k : k + 1024] @ x.T
        s[np.arange(len(s)), np.arange(k, k + len(s))] = -np.inf
        out[k : k + 1024] = np.argpartition(-s, degree - 1, axis=1)[:, :degree]
    return out


def balanced(near: np.ndarray, part: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 12) -> np.ndarray:
    """Parts with fewer edges between them: vertices move where most of their neighbours are, those that gain most first, while that part has room."""
    n, part = len(near), part.copy()
    room = int(np.ceil(n / parts * slack))
    a, b = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    for _ in range(rounds):
        held = np.zeros((n, parts), np.int32)
        np.add.at(held, (a, part[b]), 1)
        np.add.at(held, (b, part[a]), 1)
        best = held.argmax(axis=1)
        gain = held[np.arange(n), best] - held[np.arange(n), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable")[: np.count_nonzero(gain > 0)].tolist():
            if size[best[i]] < room:
                size[part[i]] -= 1
                part[i] = best[i]
                size[part[i]] += 1
                moved += 1
        if moved <= n // 200:
            break
    return part


def classifier(x: np.ndarray, target: np.ndarray, epochs: int = 60, rate: float = 0.2) -> np.ndarray:
    """Weights of a softmax over parts, fitted to target shares by Adam in batches; rows in the order given."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros((x.shape[1], target.shape[1]))
    mean, square, step = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(epochs):
        for k in range(0, len(x), 1024):
            p = softmax(x[k : k + 1024] @ w)
            g = x[k : k + 1024].T @ (p - target[k : k + 1024]) / len(p)
            step += 1
            mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
            w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return w


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Router:
    """weights: of the classifier, for vectors divided by scale; probes: parts that a query is sent to; sample: (rows' numbers, smallest ids, vectors)."""

    weights: np.ndarray
    scale: float
    probes: int
    sample: tuple[np.ndarray, np.ndarray, np.ndarray]

    def parts(self, x: np.ndarray, count: int) -> np.ndarray:
        """Each row's most probable parts, the most probable first."""
        z = (x / self.scale) @ self.weights[:-1] + self.weights[-1]
        return np.argsort(-z, axis=1, kind="stable")[:, :count]


def fitted(sample: tuple[np.ndarray, np.ndarray, np.ndarray], parts: int, recall: float = RECALL) -> Router:
    x = sample[2]
    n, scale = len(x), float(np.sqrt((x**2).sum(axis=1).mean())) if len(x) else 1.0
    x, degree = x / scale, min(DEGREE, n - 1)
    if parts < 2 or degree < 1:
        return Router(np.zeros((x.shape[1] + 1, 1)), scale, 1, sample)
    near = graph(x, degree)
    part = balanced(near, bisected(x, parts), parts)
    target = np.zeros((n, parts))
    np.add.at(target, (np.repeat(np.arange(n), degree), part[near].ravel()), 1.0)
    target[np.arange(n), part] += degree / 4
    target /= target.sum(axis=1, keepdims=True)
    held = max(1, n // 8)
    router = Router(classifier(x[held:], target[held:]), scale, parts, sample)
    order = router.parts(sample[2], parts)
    place = np.empty((held, parts), np.int64)
    np.put_along_axis(place, order[:held], np.arange(parts)[None].repeat(held, axis=0), axis=1)
    needed = np.bincount(np.take_along_axis(place, order[:, 0][near[:held]], axis=1).ravel(), minlength=parts)
    router.probes = int(np.searchsorted(np.cumsum(needed) / needed.sum(), recall) + 1)
    return router


def vectors_of(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


PLACED = pa.schema([("part", pa.int32()), ("u", pa.int64()), ("low", pa.int64()), ("floor", pa.float64()), ("v", pa.list_(pa.float64()))])


def _placed(router, dim: int, k: int, ask: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector's part; or each query's parts, with the score of its k-th sampled neighbour."""
    r = router.value
    for batch in batches:
        for first in range(0, batch.num_rows, 1024):
            b = batch.slice(first, 1024)
            x = vectors_of(b, "v", dim)
            parts = r.parts(x, r.probes if ask else 1)
            floor = np.full(len(x), -np.inf)
            if ask and len(r.sample[0]) >= k:
                floor = np.partition(x @ r.sample[2].T, -k, axis=1)[:, -k]
            rows = np.repeat(np.arange(len(x)), parts.shape[1])
            yield pa.record_batch([pa.array(parts.ravel().astype(np.int32)), *(b.column(b.schema.get_field_index(c)).take(pa.array(rows)) for c in ("u", "low")), pa.array(floor[rows]), b.column(b.schema.get_field_index("v")).take(pa.array(rows))], schema=PLACED)


FOUND = pa.schema([("q", pa.int64()), ("u", pa.int64()), ("low", pa.int64()), ("score", pa.float64())])


def best(q: np.ndarray, x: np.ndarray, floor: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, vector's row, score) of each query's k highest scores at or over its floor, smaller ids first among equals.

    Rows are chosen by matrix product with a margin for its rounding; their scores are then summed place by place.
    """
    s = q @ x.T
    margin = 1e-12 * np.sqrt((q**2).sum(axis=1) * (x**2).sum(axis=1).max(initial=0))
    bar = np.maximum(np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else -np.inf, floor) - margin
    a, b = np.nonzero(s >= bar[:, None])
    score = scored(q, x, a, b)
    order = np.lexsort((low[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    keep = (np.arange(len(a)) - np.searchsorted(a, a, "left") < k) & (score >= floor[a] - margin[a])
    return a[keep], b[keep], score[keep]


def scored(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows a of q with rows b of x, summed from the first place to the last."""
    out = np.zeros(len(a))
    for d in range(q.shape[1]):
        out += q[a, d] * x[b, d]
    return out


def _sampled(router, dim: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each query's k best of the sample."""
    us, lows, x = router.value.sample
    for batch in batches:
        for first in range(0, batch.num_rows, 1024):
            b = batch.slice(first, 1024)
            q = vectors_of(b, "v", dim)
            rows, cols, score = best(q, x, np.full(len(q), -np.inf), lows, k)
            yield pa.record_batch([b.column(b.schema.get_field_index("u")).take(pa.array(rows)), pa.array(us[cols]), pa.array(lows[cols]), pa.array(score)], schema=FOUND)


BLOCKS = "part int, u binary, low binary, floor binary, v binary"


def _blocks(rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one part after the other, a block of at most `rows` at a time; rows come sorted by part."""
    schema = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("u", "low", "floor", "v"))])
    kept, size = [], 0

    def block():
        t = pa.Table.from_batches(kept)
        cols = [t.column(c).combine_chunks() for c in ("u", "low", "floor", "v")]
        cols[-1] = cols[-1].flatten()
        return pa.record_batch([pa.array([kept[0].column(0)[0].as_py()], pa.int32()), *(pa.array([c.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for c in cols)], schema=schema)

    for batch in batches:
        part = batch.column(0).to_numpy()
        ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part))
        first = 0
        for end in ends.tolist():
            while first < end:
                if kept and (size == rows or kept[0].column(0)[0].as_py() != part[first]):
                    yield block()
                    kept, size = [], 0
                take = min(end - first, rows - size)
                kept.append(batch.slice(first, take))
                first, size = first + take, size + take
    if kept:
        yield block()


def _met(dim: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block of queries with a block of vectors of one part: each query's k best there."""
    for batch in batches:
        for r in range(batch.num_rows):
            c = {n: np.frombuffer(batch.column(i)[r].as_buffer(), np.int64 if n in ("u", "low", "qu") else np.float64) for i, n in enumerate(batch.schema.names)}
            rows, cols, score = best(c["qv"].reshape(-1, dim), c["v"].reshape(-1, dim), c["floor"], c["low"], k)
            yield pa.record_batch([pa.array(c["qu"][rows]), pa.array(c["u"][cols]), pa.array(c["low"][cols]), pa.array(score)], schema=FOUND)


def cleaned(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, v array of doubles) of the rows that take part, and how long vectors are."""
    d = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    d = d.where("vec_id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")
    size = d.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = size.dim if size else 0
    return d.where(F.size("v") == dim), dim


def neighbours(rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id long, rank int, vec_id long, score double): for each row of queries the k rows nearest to it by inner product that were found.

    queries must be rows of rows. Nearest first, smaller ids first among equals; a row is never its own neighbour, nor are others with its
    id. Rows with a null id or vector, with null or non-finite components, of zeros only, or of another length than most vectors' (the
    shorter one where two are as frequent) take no part. Repeated rows count once; vectors with one id but other components are rows of
    their own. With k rows or fewer, all are found. Other columns aren't read.
    """
    spark, most = rows.sparkSession, k + 1
    clean, dim = cleaned(rows, id_col, vector_col)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    first = F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))
    once = clean.distinct().withColumn("h", F.xxhash64("v")).withColumn("place", first).where(F.col("place") <= most)
    once = once.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    vectors = written(once.select(F.monotonically_increasing_id().alias("u"), F.col("ids")[0].alias("low"), "ids", "h", "v"))
    n = vectors.count()
    drawn = vectors.where(F.pmod(F.xxhash64("low", "h"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30))).select("u", "low", "v").limit(2 * SAMPLE).toPandas().sort_values(["low", "u"])
    sample = (drawn["u"].to_numpy(), drawn["low"].to_numpy(), np.array(drawn["v"].tolist(), np.float64).reshape(-1, dim))
    router = spark.sparkContext.broadcast(fitted(sample, min(PARTS, int(n**0.5 / 2)), recall))

    asked, _ = cleaned(queries, id_col, vector_col)
    asked = asked.where(F.size("v") == dim).distinct().withColumn("h", F.xxhash64("v")).join(vectors.select("u", "h", "v"), ["h", "v"]).select(F.col("vec_id").alias("query_id"), F.col("u").alias("q"))
    asked = written(asked)
    ask = vectors.join(asked.select(F.col("q").alias("u")).distinct(), "u", "left_semi").select("u", "low", "v")

    def blocks(of: DataFrame, ask: bool, size: int) -> DataFrame:
        kind = "part int, u long, low long, floor double, v array<double>"
        placed = mapped(of, partial(_placed, router, dim, most, ask), kind).withColumn("salt", F.pmod("u", F.lit(16)))
        return mapped(placed.repartition("part", "salt").sortWithinPartitions("part").drop("salt"), partial(_blocks, size), BLOCKS)

    size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))
    there = blocks(vectors.select("u", "low", "v"), False, size).drop("floor")
    here = blocks(ask, True, max(1, size // 8)).select("part", F.col("u").alias("qu"), "floor", F.col("v").alias("qv"))
    kind = "q long, u long, low long, score double"
    found = mapped(here.join(there, "part").drop("part"), partial(_met, dim, most), kind).unionByName(mapped(ask, partial(_sampled, router, dim, most), kind))
    # a sampled neighbour may be found in its part again: twice as many rows hold all
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "low", "u"))
    near = found.withColumn("place", place).where(F.col("place") <= 2 * most).groupBy("q").agg(F.collect_set(F.struct(F.negative("score").alias("far"), "low", "u")).alias("near"))
    near = near.select("q", F.explode(F.slice(F.sort_array("near"), 1, most)).alias("x")).select("q", "x.far", "x.u").join(vectors.select("u", "ids"), "u")
    near = near.select("q", F.explode(F.transform("ids", lambda i: F.struct("far", i.alias("vec_id")))).alias("x")).groupBy("q").agg(F.slice(F.sort_array(F.collect_list("x")), 1, most).alias("near"))
    out = asked.join(near, "q").select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("place", "x"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.negative("x.far").alias("score"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of all `embeddings` for each whose vec_id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    return neighbours(rows, rows.where("vec_id % 20 = 0"))
