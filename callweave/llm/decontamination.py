"""Benchmark passages in training text, by a generalised suffix automaton over the items' words."""

from __future__ import annotations

import itertools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import frames, words, workers
from callweave.session import table, written

WINDOW = 10
#: Bytes of item text in one automaton (some 100 MB of memory each). More items go into further ones, each over all rows.
ITEM_BYTES = 1 << 20
#: Above this share of hit words a document goes as a whole.
COVERAGE = 0.5


class Automaton:
    """All runs of words of the items, one state for each set of runs that end at the same places.

    top[v]: for states of at least `window` words, the state of their last `window` words. owners[v]: the items with that
    window. short[v]: (length, item) of the items of fewer words that end the runs of v.
    """

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window, self.names = window, [name for name, _ in items]
        texts = pa.array([t for _, t in items], pa.string())
        split = [(w.hash[w.ptr[r] : w.ptr[r + 1]], w.first + r) for w in words.chunks(texts, words.ALNUM) for r in range(len(w.n))]
        self.vocabulary = np.unique(np.concatenate([h for h, _ in split] + [np.zeros(0, np.uint64)]))
        self.size = max(1, len(self.vocabulary))
        runs = [(np.searchsorted(self.vocabulary, h).tolist(), k) for h, k in split if len(h)]
        self.least = min((min(window, len(r)) for r, _ in runs), default=window)
        self.go: dict[int, int] = {}
        self.link, self.length, outs = [-1], [0], [[]]
        for r, _ in runs:
            last = 0
            for c in r:
                last = self._add(last, c, outs)
        self.top = self._tops()
        self.owners: dict[int, list[int]] = {}
        own_short: dict[int, list[tuple[int, int]]] = {}
        for r, k in runs:
            v = 0
            for i, c in enumerate(r):
                v = self.go[v * self.size + c]
                if i + 1 >= window:
                    at = self.owners.setdefault(self.top[v], [])
                    if not at or at[-1] != k:
                        at.append(k)
            if len(r) < window:
                while self.length[self.link[v]] >= len(r):
                    v = self.link[v]
                own_short.setdefault(v, []).append((len(r), k))
        self.short = {}
        if own_short:
            for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
                if found := own_short.get(v, []) + self.short.get(self.link[v], []):
                    self.short[v] = found

    def _state(self, length: int, link: int, outs: list, of: int | None = None) -> int:
        v = len(self.link)
        self.length.append(length)
        self.link.append(link)
        outs.append(list(outs[of]) if of is not None else [])
        if of is not None:
            for c in outs[of]:
                self.go[v * self.size + c] = self.go[of * self.size + c]
        return v

    def _fork(self, p: int, c: int, q: int, outs: list) -> int:
        """The state of p's runs with c put behind them, taken out of q where q also has longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        r = self._state(self.length[p] + 1, self.link[q], outs, q)
        self.link[q] = r
        while p >= 0 and self.go.get(p * self.size + c) == q:
            self.go[p * self.size + c] = r
            p = self.link[p]
        return r

    def _add(self, last: int, c: int, outs: list) -> int:
        if (q := self.go.get(last * self.size + c)) is not None:
            return self._fork(last, c, q, outs)
        v, p = self._state(self.length[last] + 1, 0, outs), last
        while p >= 0 and (q := self.go.get(p * self.size + c)) is None:
            self.go[p * self.size + c] = v
            outs[p].append(c)
            p = self.link[p]
        self.link[v] = 0 if p < 0 else self._fork(p, c, q, outs)
        return v

    def _tops(self) -> dict[int, int]:
        top = {}
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            if self.length[v] >= self.window:
                top[v] = top[self.link[v]] if self.length[self.link[v]] >= self.window else v
        return top

    def scan(self, run: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit words of a run of known words, as (start, end), and the items hit. The longest match that ends at each word is tracked."""
        go, link, length, size, window = self.go, self.link, self.length, self.size, self.window
        spans, items = [], set()
        v = n = 0
        for i, c in enumerate(run):
            while (to := go.get(v * size + c)) is None and v:
                v = link[v]
                n = length[v]
            if to is None:
                continue
            v, n = to, n + 1
            reach = 0
            if n >= window:
                w = v if n > length[link[v]] else link[v]
                items.update(self.owners[self.top[w]])
                reach = window
            for m, k in self.short.get(v, ()):
                if m <= n:
                    items.add(k)
                    reach = max(reach, m)
            if reach:
                lo = i + 1 - reach
                while spans and spans[-1][1] >= lo:
                    lo = min(lo, spans.pop()[0])
                spans.append((lo, i + 1))
        return spans, items

    def hits(self, w: words.Words) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
        """Row -> its hit words, counted from its first, and its items. Only runs of words that items have, long enough for a window, are looked at."""
        if not len(w.hash) or not len(self.vocabulary):
            return {}
        at = np.minimum(np.searchsorted(self.vocabulary, w.hash), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == w.hash
        first = np.zeros(len(known) + 1, bool)
        first[w.ptr] = True
        before = np.concatenate([[False], known[:-1]])
        start = np.flatnonzero(known & (~before | first[:-1]))
        after = np.concatenate([known[1:], [False]])
        end = np.flatnonzero(known & (~after | first[1:])) + 1
        long = end - start >= self.least
        found: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
        rows = np.searchsorted(w.ptr, start[long], "right") - 1
        for a, b, r in zip(start[long].tolist(), end[long].tolist(), rows.tolist(), strict=True):
            spans, items = self.scan(at[a:b].tolist())
            if spans:
                own = found.setdefault(r, ([], set()))
                a -= int(w.ptr[r])
                own[0].extend((a + x, a + y) for x, y in spans)
                own[1].update(items)
        return found


def opened(key: str, shared, window: int) -> Automaton:
    """The automaton of a broadcast block of items, built once in each worker."""
    return workers.held(key, lambda: Automaton(shared.value, window))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


ROW = "starts array<int>, ends array<int>, items array<string>, n_words long"
INTS, STRINGS = pa.list_(pa.int32()), pa.list_(pa.string())


def _pass(batches, key, shared, window):
    auto = opened(key, shared, window)
    for b in batches:
        names = b.schema.names
        starts, ends, items, counts = [], [], [], []
        old = [b.column(c).to_pylist() for c in ("starts", "ends", "items")]
        for w in words.chunks(b.column("text"), words.ALNUM):
            found = auto.hits(w)
            counts.append(w.n)
            for r in range(len(w.n)):
                spans, own = found.get(r, ([], ()))
                k = w.first + r
                both = merged(spans + list(zip(old[0][k], old[1][k], strict=True)))
                starts.append([x for x, _ in both])
                ends.append([y for _, y in both])
                items.append(sorted({auto.names[i] for i in own} | set(old[2][k])))
        new = {"starts": pa.array(starts, INTS), "ends": pa.array(ends, INTS), "items": pa.array(items, STRINGS), "n_words": pa.array(np.concatenate([*counts, np.zeros(0, np.int64)]), pa.int64())}
        yield pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in names], names)


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", limit: int = ITEM_BYTES):
    """Lists of (item id, text) of at most `limit` bytes, one after the other; a longer item has a list of its own. Null texts have no words."""
    block, size = [], 0
    for r in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL").toLocalIterator():
        if block and size + len(r.t) > limit:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t)
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = ITEM_BYTES) -> DataFrame:
    """docs (text string not null, ...) -> with starts, ends (hit words), items (their ids, sorted), n_words. No shuffle; one pass over docs for each block of items."""
    spark = docs.sparkSession
    none = [F.array().cast("array<int>").alias("starts"), F.array().cast("array<int>").alias("ends"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("n_words")]
    rows = docs.select("*", *none)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    blocks = item_blocks(benchmark, limit=limit)
    for k, block in enumerate(itertools.chain([next(blocks, [])], blocks)):  # words are counted even without items
        shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex
        rows = written(rows) if k else rows
        rows = workers.mapped(rows, lambda bs, key=key, shared=shared: _pass(bs, key, shared, window), kinds, holds=True)
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row for each row of docs.

    Words are runs of digits, letters and all beyond ASCII, A-Z lower-cased. A window is `window` consecutive words of an item;
    an item of fewer words, but not none, is one window. Words inside any occurrence of a window are hit. Null and empty texts
    have no words; null ids and repeated rows stay; items that repeat an id count once; a null item id counts as an empty
    string; extra columns are not read; without items, or rows, nothing is hit.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    m = matches(rows, benchmark, window)
    hit = F.expr("aggregate(zip_with(ends, starts, (e, s) -> CAST(e - s AS BIGINT)), 0L, (a, x) -> a + x)")
    out = m.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def cut(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> list[str]:
    """The texts without their hit words and what stands between those, a line end in place of each span."""
    s, e, out = starts.to_pylist(), ends.to_pylist(), []
    for w in words.chunks(texts, words.ALNUM):
        raw = words.buffers(texts.slice(w.first, len(w.n)))[0]
        for r in range(len(w.n)):
            a, b, p = int(w.text[r]), int(w.text[r + 1]), int(w.ptr[r])
            parts = []
            for x, y in zip(s[w.first + r], e[w.first + r], strict=True):
                parts.append(raw[a : w.start[p + x]].tobytes())
                a = int(w.end[p + y - 1])
            out.append(b"\n".join([*parts, raw[a:b].tobytes()]).decode())
    return out


def _cleaned(batches, key, shared, window, coverage):
    """Cut, and looked at again, until no hit is left; rows over the coverage go."""
    auto = opened(key, shared, window)
    for b in batches:
        text = b.column("text")
        keep = np.ones(b.num_rows, bool)
        new: dict[int, str] = {}
        todo, part = np.arange(b.num_rows), text
        while len(todo):
            again, starts, ends = [], [], []
            for w in words.chunks(part, words.ALNUM):
                for r, (spans, _) in auto.hits(w).items():
                    k, both = w.first + r, merged(spans)
                    if sum(y - x for x, y in both) > coverage * w.n[r]:
                        keep[todo[k]] = False
                    else:
                        again.append(k)
                        starts.append([x for x, _ in both])
                        ends.append([y for _, y in both])
            part = pa.array(cut(part.take(pa.array(again, pa.int64())), pa.array(starts, INTS), pa.array(ends, INTS)), pa.string())
            todo = todo[again]
            new |= dict(zip(todo.tolist(), part.to_pylist(), strict=True))
        if new:
            text = pa.array([new.get(k, t) for k, t in enumerate(text.to_pylist())], pa.string())
        yield pa.RecordBatch.from_arrays([text if c == "text" else b.column(c) for c in b.schema.names], b.schema.names).filter(pa.array(keep))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, coverage: float = COVERAGE, limit: int = ITEM_BYTES) -> DataFrame:
    """docs without benchmark passages, in docs' columns: rows go whose hit words are over `coverage` of all their words; from others the spans of hit words are cut.

    Cutting goes on until a row has no hit: what stood on both sides of a span may match together. Coverage is that of what is
    left each time. Rows without hits keep their text as it is, null or not, and every other column. Items beyond one automaton
    are looked for in turn, and all of them again as long as any row was cut. No shuffle.
    """
    spark = docs.sparkSession
    rows, names = frames.plain(docs, text_col)
    rows = rows.withColumn("none", F.col(f"c{names.index(text_col)}").isNull()).drop(f"c{names.index(text_col)}")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    blocks = item_blocks(benchmark, limit=limit)
    first, more = next(blocks, []), next(blocks, None)

    def clean(rows, block):
        shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex
        return workers.mapped(rows, lambda bs: _cleaned(bs, key, shared, window, coverage), kinds, holds=True)

    rows = clean(rows, first)
    while more is not None:
        rows = written(rows)
        before = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
        for block in itertools.chain([more], blocks):
            rows = written(clean(rows, block))
        if rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first() == before:
            break
        blocks = item_blocks(benchmark, limit=limit)
        more = next(blocks)
    return rows.select(*[F.when(~F.col("none"), F.col("text")).alias(c) if c == text_col else F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
