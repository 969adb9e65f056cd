"""SpotSigs fingerprints: chains of content words behind common words, as sets of hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import near_dups, words, workers
from callweave.llm.groups import components
from callweave.session import checkpointed, table, written

#: Common words of English, German, French and Spanish that signatures stand behind.
ANCHORS = """
the of and a to in is was for that it with as on be by this are or an at from not have but they which
der die das und ist ein eine zu den von mit auf nicht sich des dem im für auch als
le la les de et un une est que du en pour dans qui sur par au ce il
el los las y se del no una con su al lo es más o
"""
#: Content words in a signature.
CHAIN = 2
KEYS = words.constants(CHAIN + 2, 41)
#: Rows of neighbouring ids that are sorted together.
BIN_ROWS = 1000
MOST_BINS = 10_000
#: Jaccard from which two sets are linked.
LEAST = 0.75
#: Slots of the counts that order signatures from rare to common. The order decides which candidates there are, never which links.
SLOTS = 1 << 20
SUM = words.constants(4, 43)
#: Steps of 1 / least in a partition of lengths.
SPAN = 4
#: Rounds in which all of a bucket are held against one member that is drawn, before all that are left are held against each other.
ROUNDS = 3


def _hashes(text: str) -> np.ndarray:
    return np.unique(next(words.chunks(pa.array([text]), words.ALNUM)).hash)


COMMON = _hashes(ANCHORS)


def chains(h: np.ndarray, anchor: np.ndarray, content: np.ndarray, ptr: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each anchor with the next n content words of its text, and the text of each."""
    at = np.flatnonzero(content)
    before = np.concatenate([[0], np.cumsum(content)])
    spot = np.flatnonzero(anchor)
    row = np.searchsorted(ptr, spot, "right") - 1
    first = before[spot + 1]
    fits = first + n <= before[ptr[row + 1]]
    spot, row, first = spot[fits], row[fits], first[fits]
    sig = h[spot] * KEYS[0]
    for j in range(n):
        sig = sig + h[at[first + j]] * KEYS[j + 1]
    return words.mix(sig), row


def signatures(texts: list[str]) -> list[np.ndarray]:
    """The set of each text, as sorted 32-bit numbers.

    A text without any chain behind a common word gives the chains behind all its words, one of fewer words its whole
    sequence, one without words none.
    """
    out = []
    for w in words.chunks(pa.array(texts, pa.string()), words.ALNUM):
        anchor = np.isin(w.hash, COMMON)
        sig, row = chains(w.hash, anchor, ~anchor, w.ptr, CHAIN)
        n = len(w.ptr) - 1
        bare = (np.bincount(row, minlength=n) == 0) & (w.n > CHAIN)
        if bare.any():
            every = np.repeat(bare, w.n)
            more, of = chains(w.hash, every, np.ones(len(every), bool), w.ptr, CHAIN)
            sig, row = np.concatenate([sig, more]), np.concatenate([row, of])
            order = np.argsort(row, kind="stable")
            sig, row = sig[order], row[order]
        ends = np.searchsorted(row, np.arange(n + 1))
        for r in range(n):
            own = sig[ends[r] : ends[r + 1]]
            if not len(own) and w.ptr[r] < w.ptr[r + 1]:
                h = w.hash[w.ptr[r] : w.ptr[r + 1]]
                own = words.mix((h * KEYS[: len(h)]).sum(keepdims=True) + KEYS[-1])
            out.append(np.unique((own >> np.uint64(32)).astype(np.uint32)))
    return out


def fingerprint(s: np.ndarray) -> str:
    """A set as text: its numbers in order, 8 hexadecimal digits each."""
    return s.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sets; 0 without a comparison where their sizes alone rule out `least`. Two empty sets are alike."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small / large < least:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (small + large - both)


def _dealt(batches, bounds):
    """Rows with their bin; the first id of a bin goes to the bin before as well, the first of all to the last."""
    press = zstandard.ZstdCompressor(level=1).compress
    last = max(0, len(bounds) - 1)
    for b in batches:
        ids = b.column("id")
        null = ids.is_null().to_numpy(zero_copy_only=False)
        i = ids.fill_null(0).to_numpy()
        own = np.where(null, last, np.maximum(0, np.searchsorted(bounds, i, "right") - 1)) if len(bounds) else np.zeros(len(i), np.int64)
        edge = ~null & (bounds[own] == i) if len(bounds) else np.ones(len(i), bool)
        twice = np.flatnonzero(edge)
        take = np.concatenate([np.arange(len(i)), twice])
        bins = np.concatenate([own, np.where(own[twice] > 0, own[twice] - 1, last)])
        tail = np.concatenate([np.zeros(len(i), bool), np.ones(len(twice), bool)])
        blobs = [press(t.encode()) for t in b.column("text").to_pylist()]
        for k in range(0, len(take), 512):
            part = take[k : k + 512]
            yield pa.RecordBatch.from_arrays([pa.array(bins[k : k + 512], pa.int32()), pa.array(tail[k : k + 512]), ids.take(pa.array(part)), pa.array([blobs[x] for x in part], pa.binary())], ["bin", "tail", "id", "blob"])


def _followed(batches):
    """(id, text, text of the next row) of rows in order of bin, tail and id."""
    open_ = zstandard.ZstdDecompressor().decompress
    held = None
    for b in batches:
        for k, tail, i, blob in zip(*(b.column(c).to_pylist() for c in ("bin", "tail", "id", "blob")), strict=True):
            if tail and (held is None or held[0] != k):
                continue
            text = open_(blob).decode()
            if held is not None:
                yield held[1], held[2], text
            held = None if tail else (k, i, text)


def _marked(batches):
    def flush():
        texts = [t for _, t, _ in todo]
        k = len(texts)
        edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for _, t, n in todo]
        nexts = [x + 1 if x + 1 < k and todo[x][2] is texts[x + 1] else None for x in range(k)]
        sets = signatures(texts + edited + [todo[x][2] for x in range(k) if nexts[x] is None])
        rest = iter(sets[2 * k :])
        following = [next(rest) if x is None else sets[x] for x in nexts]
        cols = [
            pa.array([i for i, _, _ in todo], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array([fingerprint(s) for s in sets[:k]]),
            pa.array([fingerprint(s) for s in sets[k : 2 * k]]),
            pa.array([likeness(sets[x], sets[k + x]) for x in range(k)], pa.float64()),
            pa.array([likeness(sets[x], following[x]) for x in range(k)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    todo, size = [], 0
    for row in _followed(batches):
        todo.append(row)
        size += len(row[1])
        if size >= words.CHUNK or len(todo) == 500:
            yield flush()
            todo, size = [], 0
    if todo:
        yield flush()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bin_rows: int = BIN_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row for each row of docs.

    A fingerprint is the set of a text's signatures. The edited text has the last quarter of a text's characters replaced by
    the first as many (or all) of the next document by rising id; after the last comes the first. near_edited and near_next
    are the Jaccard likeness with the edited text's set and the next document's. Null texts count as empty; two texts without
    words are alike. Null ids come last; rows that repeat an id follow each other in a fixed order; extra columns are not read;
    an empty table gives an empty one. Texts are shuffled once, compressed, into bins of neighbouring ids, each of which has the
    first row of the next bin as well, and stream by in order.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = rows.count()
    bins = max(1, min(n // bin_rows, MOST_BINS))
    at = [k / bins for k in range(bins)]
    least, cuts = rows.agg(F.min("id"), F.percentile_approx("id", at, max(10_000, 20 * bins))).first()
    bounds = np.unique(np.array([least, *(cuts or [])], np.int64)) if least is not None else np.zeros(0, np.int64)
    dealt = workers.mapped(rows, lambda bs: _dealt(bs, bounds), "bin int, tail boolean, id long, blob binary")
    # several bins to a task: hashing deals them unevenly, and a task streams them
    tasks = max(1, min(bins, n // (8 * bin_rows) + 1)) if bins > 1 else 1
    ordered = dealt.repartition(max(tasks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "bin").sortWithinPartitions("bin", "tail", F.col("id").asc_nulls_last(), "blob")
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return workers.mapped(ordered, _marked, kinds)


def _set_rows(batches):
    for b in batches:
        sets = signatures(b.column("text").to_pylist())
        sums = [[int(words.mix(s ^ SUM[c]).sum(dtype=np.uint64).astype(np.int64)) for s in (x.astype(np.uint64) for x in sets)] for c in (0, 1)]
        cols = [b.column("id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(d, pa.int64()) for d in sums), pa.array([s.tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["id", "n", "d1", "d2", "sigs"])


def _slot(s: np.ndarray) -> np.ndarray:
    return (words.mix(s.astype(np.uint64) ^ SUM[2]) >> np.uint64(44)).astype(np.int64)


def _slots_counted(batches):
    c = np.zeros(SLOTS, np.int64)
    for b in batches:
        for blob in b.column("sigs").to_pylist():
            np.add.at(c, _slot(np.frombuffer(blob, np.uint32)), 1)
    at = np.flatnonzero(c)
    for k in range(0, len(at), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 50_000], pa.int32()), pa.array(c[at[k : k + 50_000]])], ["slot", "c"])


def slot_counts(sets: DataFrame) -> np.ndarray:
    """How many signatures of all sets fall into each slot."""
    got = workers.mapped(sets.select("sigs"), _slots_counted, "slot int, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[got["slot"].to_numpy()] = got["c"].to_numpy()
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def shortest(n: int, least: float) -> int:
    """Size of the smallest set that can be as alike as `least` to one of size n."""
    m = max(1, int(least * n) - 1)
    while m / n < least:
        m += 1
    return m


def lengths(longest: int, least: float) -> np.ndarray:
    """Where each partition of lengths begins. A set and the shortest that can be alike are in one partition or in two neighbouring ones."""
    out = [1]
    while out[-1] <= longest and least < 1:
        b = out[-1]
        for _ in range(SPAN):
            m = int(b / least) + 2
            while shortest(m - 1, least) > b:
                m -= 1
            b = m
        out.append(b)
    return np.array(out, np.int64)


def _rare(batches, shared, least):
    """(bucket, id, n): the rarest signatures of each set, one of which is in any set that is alike, by partition of lengths."""
    counts, starts = shared.value
    for b in batches:
        sets = [np.frombuffer(x, np.uint32) for x in b.column("sigs").to_pylist()]
        if not sets:
            continue
        n = np.array([len(s) for s in sets])
        small = np.array([shortest(k, least) for k in n.tolist()])
        s = np.concatenate(sets)
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((s, counts[_slot(s)], row))
        first = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(n - small + 1, n)
        s, row = s[order][first].astype(np.uint64), row[first]
        own, low = (np.searchsorted(starts, x, "right") - 1 for x in (n, small))
        also = low[row] < own[row]
        part = np.concatenate([own[row], low[row][also]]).astype(np.uint64)
        bucket = words.mix(np.concatenate([s, s[also]]) * SUM[3] + words.mix(part)).view(np.int64)
        row = np.concatenate([row, row[also]])
        ids = b.column("id").to_numpy()
        for k in range(0, len(row), 50_000):
            r = row[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[k : k + 50_000]), pa.array(ids[r], pa.int64()), pa.array(n[r], pa.int64())], ["bucket", "id", "n"])


def _alike(batches, least):
    for b in batches:
        sides = ([np.frombuffer(x, np.uint32) for x in b.column(c).to_pylist()] for c in ("sigs_a", "sigs_b"))
        linked = [likeness(x, y, least) >= least for x, y in zip(*sides, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(linked, pa.bool_()))


def _blocks_alike(batches, least):
    for b in batches:
        for k in range(b.num_rows):
            x, y = (b.column(c)[k].as_py() for c in ("x", "y"))
            sets = []
            for side in (x, y):
                of = [np.frombuffer(r["sigs"], np.uint32) for r in side]
                size = np.array([len(s) for s in of])
                sets.append((np.concatenate(of), np.repeat(np.arange(len(of)), size), size))
            both = near_dups.shared(*sets)
            ids, group = ([np.array([r[c] for r in side], np.int64) for side in (x, y)] for c in ("id", "component"))
            linked = (both / (sets[0][2][:, None] + sets[1][2][None, :] - both) >= least) & (group[0][:, None] != group[1][None, :])
            i, j = np.nonzero(linked)
            pairs = np.unique(np.sort(np.stack([ids[0][i], ids[1][j]], axis=1), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])


def alike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, block_bytes: int = near_dups.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_signatures, component_id, kept: one row for each row of docs.

    Linked are documents whose sets of signatures have a Jaccard likeness of `least` or more, wherever their ids are;
    component_id is the smallest doc_id that links lead to; kept is doc_id = component_id. Null texts count as empty; texts
    without words have no links. A row without an id is linked with nothing: component_id null, kept true. Rows that repeat an
    id are one document; extra columns are not read; an empty table gives an empty one.

    No link is lost. Equal sets fold into one first. Sets are dealt to partitions by their size, those whose smallest alike sets
    are one partition below to that as well; two alike ones share one of their rarest signatures (all but least * size - 1 of
    them, in one order for all sets), so a bucket is a partition and such a signature. In each bucket all members are held for
    some rounds against one that is drawn; then every pair whose ends are still in different groups is held against each other,
    block by block.
    """
    if not 0 < least <= 1:
        raise ValueError("least is above 0 and at most 1")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    signed = written(workers.mapped(rows, _set_rows, "id long, n long, d1 long, d2 long, sigs binary"))
    some = signed.where("id IS NOT NULL AND n > 0")
    classes = written(some.groupBy("d1", "d2").agg(F.min(F.struct("id", "n", "sigs")).alias("m")).select("d1", "d2", "m.*"))
    home = written(some.select("id", "n", "d1", "d2").join(classes.select("d1", "d2", F.col("id").alias("rep")), ["d1", "d2"]).select("id", "n", "rep"))
    several = home.groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("id")
    groups = components(home.join(several, "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    starts = lengths(classes.agg(F.max("n")).first()[0] or 1, least)
    counts = docs.sparkSession.sparkContext.broadcast((slot_counts(classes), starts))
    rare = workers.mapped(classes.select("id", "sigs"), lambda bs: _rare(bs, counts, least), "bucket long, id long, n long")
    common = rare.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1").select("bucket")
    met = written(rare.join(common, "bucket"))
    sets = written(classes.select("id", "sigs").join(met.select("id").distinct(), "id", "left_semi"))
    a, b = sets.toDF("a", "sigs_a"), sets.toDF("b", "sigs_b")
    tested = None
    for k in range(ROUNDS + 1):
        left = written(near_dups.spread(met, groups, "bucket", "id", "n"))
        if k < ROUNDS:
            drawn = left.groupBy("bucket").agg(F.max(F.struct(F.xxhash64("id", F.lit(k)).alias("draw"), *left.columns)).alias("m")).select("m.*")
            pairs = left.alias("x").join(drawn.alias("y"), F.col("x.bucket") == F.col("y.bucket")).where("x.component <> y.component")
            pairs = pairs.where(F.least("x.n", "y.n") / F.greatest("x.n", "y.n") >= least)
            pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
            pairs = checkpointed(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
            tested = pairs if tested is None else tested.union(pairs)
            both = pairs.join(a, "a").join(b, "b").select("a", "b", "sigs_a", "sigs_b")
            more = workers.mapped(both, lambda bs: _alike(bs, least), "a long, b long")
        else:
            whole = near_dups.parted(left.withColumn("size", 4 * F.col("n")), block_bytes).join(sets, "id")
            row = F.struct("id", "component", "sigs")
            members = whole.groupBy("bucket", "block").agg(F.collect_list(row).alias("y"))
            asking = whole.where("asks IS NOT NULL").groupBy("bucket", "asks").agg(F.collect_list(row).alias("x"))
            more = workers.mapped(asking.join(members, "bucket").select("x", "y"), lambda bs: _blocks_alike(bs, least), "a long, b long")
        more = checkpointed(more)
        if not more.isEmpty():
            groups = components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    of = groups.select(F.col("id").alias("rep"), "component")
    linked = home.join(of, "rep", "left").select("id", "n", F.coalesce("component", "rep").alias("component_id"))
    out = linked.union(signed.where("id IS NULL OR n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_signatures"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op7_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alike(table(spark, sf_dir, "documents"))
