"""Interpolated modified Kneser-Ney n-grams of code points: counts and costs by joins on the n-grams.

Documents are dealt to shards of some megabytes. Each shard asks once for every n-gram it has; all shards' n-grams are counted
and given their costs in Spark, order by order, and the answers go back to their shards, where texts are scored. The tables
grow with the corpus and its alphabet, and are never gathered in one place; texts move once, compressed.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.llm import words, workers
from callweave.session import WIDE_ROWS, written

ORDER = 4
#: Code points there can be: what a model without any count spreads evenly over.
ALPHABET = 0x110000
#: Line ends stand before a text.
START = 10
#: Code points of a stretch.
STRETCH = 8
#: Code points of text from which a shard is closed. A text is never parted; a longer one is a shard alone.
SHARD_SIZE = 32 << 20
#: Texts are compressed once and stored and moved so: at level 9 to four fifths of what level 1 leaves.
LEVEL = 9
#: 64 bits stand for an n-gram inside a shard: two of a million are taken for one another once in 40 million shards.
PLACE = words.constants(16, 41)


def text_chunks(texts: pa.Array):
    """(first row, bytes, where each text begins) of some rows at a time, whole texts."""
    data, at = words.buffers(texts)
    low = 0
    while low < len(at) - 1:
        high = max(low + 1, int(np.searchsorted(at, at[low] + words.CHUNK, "right")) - 1)
        yield low, data[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def spelled(texts: pa.Array, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, where each text's code points begin, code points with line ends before each text, place of each code point in them)."""
    for first, data, at in text_chunks(texts):
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
        n, pad = len(at) - 1, order - 1
        put = np.arange(len(codes)) + np.repeat(pad * np.arange(1, n + 1), np.diff(at))
        wide = np.full(len(codes) + pad * (n + 1), START, np.uint32)
        wide[put] = codes
        yield first, at, wide, put


def keys(wide: np.ndarray, put: np.ndarray, order: int) -> np.ndarray:
    """64 bits for the n-gram that ends at each place."""
    out = np.zeros(len(put), np.uint64)
    for j in range(order):
        out += wide[put - j] * PLACE[j]
    return out


def strings(points: np.ndarray) -> pa.Array:
    """Rows of code points as strings."""
    size = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).sum(axis=1)
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(points), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(data))


def new_ones(numbers: np.ndarray) -> np.ndarray:
    """Where each number stands first, in numbers that are given out as things first come."""
    return np.flatnonzero(np.diff(np.maximum.accumulate(np.concatenate([[-1], numbers]))))


class Grams:
    """The different n-grams of texts that come some at a time, numbered as they first come; points: the code points of each."""

    def __init__(self, order: int):
        self.order, self.known, self.points = order, pa.array([], pa.uint64()), []

    def numbers(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, where each text begins, number of the n-gram that ends at each code point) of some rows at a time."""
        for first, at, wide, put in spelled(texts, self.order):
            own = pa.array(keys(wide, put, self.order)).dictionary_encode()
            found = pc.index_in(own.dictionary, value_set=self.known)
            new = found.is_null().to_numpy(zero_copy_only=False)
            of = found.fill_null(0).to_numpy().copy()
            of[new] = len(self.known) + np.arange(new.sum())
            local = own.indices.to_numpy()
            ends = put[new_ones(local)][new]
            self.points.append(wide[ends[:, None] - np.arange(self.order - 1, -1, -1)])
            self.known = pa.concat_arrays([self.known, own.dictionary.filter(pa.array(new))])
            yield first, at, of[local]

    def strings(self) -> pa.Array:
        return strings(np.concatenate([*self.points, np.zeros((0, self.order), np.uint32)]))


class Shard:
    """A shard that is being filled: its rows go compressed into `sink` as they come."""

    def __init__(self, schema: pa.Schema, order: int):
        self.size, self.grams, self.counts, self.sink = 0, Grams(order), np.zeros(0, np.int64), io.BytesIO()
        self.pressed = zstandard.ZstdCompressor(level=LEVEL).stream_writer(self.sink, closefd=False)
        self.rows = pa.ipc.new_stream(pa.PythonFile(self.pressed, "w"), schema)

    def add(self, rows: pa.RecordBatch) -> None:
        self.rows.write_batch(rows)
        trained = rows.column("trained").to_numpy(zero_copy_only=False)
        for first, at, numbers in self.grams.numbers(rows.column("text")):
            more = np.bincount(numbers[np.repeat(trained[first : first + len(at) - 1], np.diff(at))], minlength=len(self.grams.known))
            more[: len(self.counts)] += self.counts
            self.counts, self.size = more, self.size + int(at[-1])

    def closed(self, name: int) -> pa.RecordBatch:
        self.rows.close()
        self.pressed.close()
        g = self.grams.strings()
        ends = pa.array([0, len(g)], pa.int32())
        cols = [pa.array([name], pa.int64()), pa.array([self.sink.getvalue()], pa.binary()), pa.ListArray.from_arrays(ends, g), pa.ListArray.from_arrays(ends, pa.array(self.counts))]
        return pa.RecordBatch.from_arrays(cols, ["shard", "docs", "grams", "counts"])


def _sharded(batches, order, size):
    task, done, shard = TaskContext.get().partitionId(), 0, None
    for b in batches:
        for first, _, at in text_chunks(b.column("text")):
            shard = shard or Shard(b.schema, order)
            shard.add(b.slice(first, len(at) - 1))
            if shard.size >= size:
                yield shard.closed((task << 32) + done)
                shard, done = None, done + 1
    if shard:
        yield shard.closed((task << 32) + done)


def sharded(rows: DataFrame, order: int = ORDER, size: int = SHARD_SIZE) -> DataFrame:
    """rows (text string not null, trained boolean not null, ...) -> shard, docs (its rows), grams (its different n-grams), counts (of each, in its trained texts): a written table, so that shards stay as they are when executors are lost."""
    out = workers.mapped(rows, lambda bs: _sharded(bs, order, size), "shard long, docs binary, grams array<string>, counts array<long>")
    return written(out, **WIDE_ROWS)


def discounts(c: Column) -> list[Column]:
    """Of counts 1, 2, 3 and more, from how many n-grams have counts 1 to 4; 0.5, 1 and 1.5 where too few have them."""
    n = [F.count_if(c == k).cast("double") for k in (1, 2, 3, 4)]
    y = F.try_divide(n[0], n[0] + 2 * n[1])
    fits = (n[0] > 0) & (n[1] > 0) & (n[2] > 0)
    return [F.when(fits, F.greatest(F.lit(0.0), F.least(F.lit(float(k)), k - (k + 1) * y * F.try_divide(n[k], n[k - 1])))).otherwise(F.lit(0.5 * k)).alias(f"d{k}") for k in (1, 2, 3)]


def tail(g: str, k: int) -> Column:
    return F.right(F.col(g), F.lit(k))


def costs(asked: DataFrame, order: int = ORDER) -> DataFrame:
    """asked (g, c: different n-grams with their counts in trained text, 0 for none) -> g, p: the probability of each one's last code point after the others.

    Lower orders count the different n-grams of the next one that end in them. An order's probability is the discounted count
    over the context's sum, and for the discounts' share that of the next lower order. An n-gram without a count has that share
    alone; after a context without counts the lower order's probability stands as it is.
    """
    seen, wanted = {order: asked.where("c > 0").select("g", "c")}, {order: asked.select("g")}
    for k in range(order - 1, 0, -1):
        seen[k] = written(seen[k + 1].groupBy(tail("g", k).alias("g")).agg(F.count("*").alias("c")))
        wanted[k] = wanted[k + 1].select(tail("g", k).alias("g")).distinct()
    p = None
    for k in range(1, order + 1):
        d = F.broadcast(seen[k].agg(*discounts(F.col("c"))))  # one row
        head = F.left(F.col("g"), F.lit(k - 1)).alias("head")
        sums = seen[k].groupBy(head).agg(F.sum("c").alias("total"), *[F.count_if(F.col("c") == j).alias(f"n{j}") for j in (1, 2)], F.count_if(F.col("c") > 2).alias("n3"))
        t = wanted[k].join(seen[k], "g", "left").select("g", "c", head).join(sums, "head", "left").crossJoin(d)
        below = F.lit(1.0 / ALPHABET)
        if k > 1:
            t, below = t.withColumn("tail", tail("g", k - 1)).join(p.select(F.col("g").alias("tail"), F.col("p").alias("below")), "tail"), F.col("below")
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        share = F.coalesce((F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total"), F.lit(1.0))
        p = written(t.select("g", (F.coalesce((F.col("c") - off) / F.col("total"), F.lit(0.0)) + share * below).alias("p")))
    return p


def worst(sums: np.ndarray, at: np.ndarray, size: int = STRETCH) -> np.ndarray:
    """Greatest mean over `size` neighbouring values, or over all of a text that has fewer, of each text [at[r], at[r + 1]), from running sums; 0 for an empty one."""
    n = np.diff(at)
    out = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(n, 1)
    long = np.flatnonzero(n > size)
    if len(long):
        means = np.append((sums[size:] - sums[:-size]) / size, 0.0)  # a last end may lie one past them
        ends = np.stack([at[long], at[long + 1] - size + 1], axis=1).ravel()
        out[long] = np.maximum.reduceat(means, ends)[::2]
    return out


def _scored(shard: pa.Table, answers: pa.Table, order: int, names: list[str]) -> pa.Table:
    """One shard's rows, from the cost of each of its n-grams."""
    cost = answers["cost"].to_numpy()[np.argsort(answers["slot"].to_numpy())].astype(np.float64)
    grams, kept = Grams(order), []
    for rows in pa.ipc.open_stream(pa.CompressedInputStream(pa.BufferReader(shard["docs"][0].as_buffer()), "zstd")):
        sizes, means, worsts = ([np.zeros(0, kind)] for kind in (np.int64, float, float))
        for _, at, numbers in grams.numbers(rows.column("text")):
            sums = np.concatenate([[0.0], np.cumsum(cost[numbers])])
            sizes.append(np.diff(at))
            means.append((sums[at[1:]] - sums[at[:-1]]) / np.maximum(sizes[-1], 1))
            worsts.append(worst(sums, at))
        n = np.concatenate(sizes)
        new = {"n_chars": pa.array(n, pa.int64()), "nll": pa.array(np.concatenate(means), mask=n == 0), "worst": pa.array(np.concatenate(worsts), mask=n == 0)}
        kept.append(pa.RecordBatch.from_arrays([new[c] if c in new else rows.column(c) for c in names], names))
    workers.given_back()
    return pa.Table.from_batches(kept)


def scored(rows: DataFrame, order: int = ORDER, keep_text: bool = True, size: int = SHARD_SIZE) -> DataFrame:
    """rows (text string not null, trained boolean not null, ...) -> with n_chars, nll: the mean negative logarithm of a code point's probability under a model of the trained rows' texts; its exponential is the perplexity; and worst: the same of the worst stretch. Null for empty texts. Without text, unless that is kept."""
    shards = sharded(rows, order, size)
    asked = written(shards.select(F.inline(F.arrays_zip("grams", "counts"))).toDF("g", "c").groupBy("g").agg(F.sum("c").alias("c")))
    cost = costs(asked, order).select("g", (-F.ln("p")).cast("float").alias("cost"))
    answers = shards.select("shard", F.posexplode("grams").alias("slot", "g")).join(cost, "g").select(F.col("shard").alias("of"), "slot", "cost")
    kinds = [f for f in rows.schema.fields if keep_text or f.name != "text"] + [T.StructField("n_chars", T.LongType()), T.StructField("nll", T.DoubleType()), T.StructField("worst", T.DoubleType())]
    names = [f.name for f in kinds]
    return shards.select("shard", "docs").groupBy("shard").cogroup(answers.groupBy("of")).applyInArrow(lambda s, a: _scored(s, a, order, names), T.StructType(kinds))
