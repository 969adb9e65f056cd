"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full shingle sets, union-find groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import words, workers
from callweave.llm.groups import components
from callweave.session import checkpointed, table, written

WORDS = 5
PERCENT = 75
SLOTS = 128
BANDS = 32
EMPTY = np.uint64(MASK := (1 << 64) - 1)
STEP = words.constants(SLOTS, 17)
BAND = words.constants(SLOTS, 29)
#: Rounds in which all of a bucket are held against one member that is drawn, before all that are left are held against each other.
ROUNDS = 2
#: Bytes of text in a block of a bucket. A longer text is a block of its own.
BLOCK_BYTES = 1 << 17


def super_minhash(elements: np.ndarray, ptr: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """A signature of `slots` numbers for each set of elements; slots a power of two up to 256.

    Element e draws a random permutation of the slots, one place in each step j, and puts the number (j, r_j) there; each slot
    keeps its least. Steps go on for all elements of a set together, and stop as soon as the set has filled its slots: what
    comes later is greater. An empty set keeps every slot at its greatest value.
    """
    sets = len(ptr) - 1
    out = np.full(sets * slots, EMPTY, np.uint64)
    size = np.diff(ptr)
    of = np.repeat(np.arange(sets), size)
    e, first, second, places = elements, None, None, None
    for j in range(slots):
        x = words.mix(e + STEP[j])
        k = (np.uint64(j) + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32))).astype(np.int64)
        if j == 0:
            slot = first = k
        elif j == 1:
            second = k
            slot = np.where(k == first, 0, k)
        else:
            if places is None:  # replay the first two steps
                places = np.tile(np.arange(slots, dtype=np.uint8), (len(e), 1))
                for step, at in ((0, first), (1, second)):
                    swap(places, step, at)
            slot = swap(places, j, k).astype(np.int64)
        value = (np.uint64(j) << np.uint64(56)) | (words.mix(x) >> np.uint64(8))
        np.minimum.at(out, of * slots + slot, value)
        open_ = (out.reshape(sets, slots) == EMPTY).any(axis=1)
        stay = open_[of]
        if not stay.any():
            break
        e, of = e[stay], of[stay]
        first, second = first[stay], second[stay] if second is not None else None
        places = places[stay] if places is not None else None
    return out.reshape(sets, slots)


def swap(places: np.ndarray, step: int, at: np.ndarray) -> np.ndarray:
    rows = np.arange(len(places))
    got = places[rows, at]
    places[rows, at] = places[:, step]
    places[:, step] = got
    return got


def _signed(batches):
    for b in batches:
        for w in words.chunks(b.column("text")):
            e, ptr = words.distinct(*words.shingles(w, WORDS))
            size = np.diff(ptr)
            sig = super_minhash(e, ptr)
            per = SLOTS // BANDS
            band = np.zeros((len(size), BANDS), np.uint64)
            for k in range(per):
                band += sig[:, k::per] * BAND[k]
            band = words.mix(band + BAND[-BANDS:])
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(words.mix(e ^ BAND[c]))]) for c in (10, 11)]
            digest = [s[ptr[1:]] - s[ptr[:-1]] for s in sums]
            filled = np.where(size > 0, BANDS, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(filled)]), pa.int32()), pa.array(band[size > 0].ravel().view(np.int64)))
            ids = b.column("id").slice(w.first, len(size))
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(np.diff(w.text), pa.int64()), *(pa.array(d.view(np.int64)) for d in digest), lists], ["id", "n", "size", "d1", "d2", "bands"])


def signatures(docs: DataFrame) -> DataFrame:
    """docs (id long, text string not null) -> id, n (distinct shingles), size (bytes of text), d1, d2 (of the whole set), bands."""
    return workers.mapped(docs, _signed, "id long, n long, size long, d1 long, d2 long, bands array<long>")


def _verified(batches):
    """Pairs whose sets, over the whole texts, have 100 * intersection >= PERCENT * union."""
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            sets = []
            for side in ("text_a", "text_b"):
                of = []
                for w in words.chunks(part.column(side)):
                    e, ptr = words.distinct(*words.shingles(w, WORDS))
                    of += [e[x:y] for x, y in zip(ptr[:-1], ptr[1:], strict=True)]
                sets.append(of)
            linked = []
            for x, y in zip(*sets, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= PERCENT * (len(x) + len(y) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(linked, pa.bool_()))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links, from texts (id, text). Spark splits the rows of an id that many pairs share."""
    a, b = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    return checkpointed(workers.mapped(both, _verified, "a long, b long"))


def fits(a, b):
    """Sets of these sizes can be alike enough."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def spread(met: DataFrame, groups: DataFrame, *columns: str) -> DataFrame:
    """Rows of met in buckets whose members are not all in one group, with their component."""
    placed = met.join(groups, "id", "left").select(*columns, F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    return placed.join(mixed, "bucket").select(*columns, "component")


def parted(left: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """left (bucket, id, component, size in bytes) -> bucket, block, asks, id, component: the members of a bucket in blocks of some block_bytes.

    asks: block of members outside the bucket's largest group. Those are to meet all blocks, others only those.
    """
    groups = left.groupBy("bucket", "component").agg(F.sum("size").alias("c"))
    size = groups.groupBy("bucket").agg(F.sum("c").alias("all"), F.max(F.struct("c", "component")).alias("most"))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.greatest(F.ceil(n / block_bytes), F.lit(1)))
    asks = F.when(F.col("component") != F.col("most.component"), deal(F.col("all") - F.col("most.c")))
    return written(left.join(size, "bucket").select("bucket", deal(F.col("all")).alias("block"), asks.alias("asks"), "id", "component"))


def blocks_verified(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The links (a, b) between different groups within large buckets. A block is one row, so that the pairs of a bucket are never rows."""
    whole = rows.join(texts, "id")
    row = F.struct("id", "component", "text")
    members = whole.groupBy("bucket", "block").agg(F.collect_list(row).alias("y"))
    asking = whole.where("asks IS NOT NULL").groupBy("bucket", "asks").agg(F.collect_list(row).alias("x"))
    return checkpointed(workers.mapped(asking.join(members, "bucket").select("x", "y"), _blocks_verified, "a long, b long"))


def _sets(block: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of all texts, each text's once, with the text's number, and how many each text has."""
    values, sizes = [], []
    for w in words.chunks(pa.array([r["text"] for r in block], pa.string())):
        e, ptr = words.distinct(*words.shingles(w, WORDS))
        values.append(e)
        sizes.append(np.diff(ptr))
    size = np.concatenate(sizes)
    return np.concatenate(values), np.repeat(np.arange(len(size)), size), size


def shared(x: tuple, y: tuple) -> np.ndarray:
    """How many shingles each text of x has in common with each of y."""
    common = np.intersect1d(x[0], y[0])
    out = np.zeros((len(x[2]), len(y[2])), np.float32)
    for lo in range(0, len(common), 8192):
        part = common[lo : lo + 8192]
        has = []
        for values, of, size in (x, y):
            at = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[at] == values
            m = np.zeros((len(size), len(part)), np.float32)
            m[of[hit], at[hit]] = 1
            has.append(m)
        out += has[0] @ has[1].T
    return out.astype(np.int64)


def _blocks_verified(batches):
    for b in batches:
        for k in range(b.num_rows):
            rows = [b.column(c)[k].as_py() for c in ("x", "y")]
            sets = [_sets(r) for r in rows]
            both = shared(*sets)
            ids, group = ([np.array([r[c] for r in side]) for side in rows] for c in ("id", "component"))
            linked = (100 * both >= PERCENT * (sets[0][2][:, None] + sets[1][2][None, :] - both)) & (both > 0) & (group[0][:, None] != group[1][None, :])
            i, j = np.nonzero(linked)
            pairs = np.unique(np.sort(np.stack([ids[0][i], ids[1][j]], axis=1), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])


def same_document(some: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the representatives of classes (d1, d2, rep) that rows of one id (id, d1, d2) are in."""
    twice = some.groupBy("id").agg(F.min(F.struct("d1", "d2")).alias("low"), F.max(F.struct("d1", "d2")).alias("high")).where("low <> high")
    of = written(some.join(twice.select("id"), "id", "left_semi").join(classes, ["d1", "d2"]).select("id", "rep"))
    return of.join(of.groupBy("id").agg(F.min("rep").alias("a")), "id").select("a", F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs.

    Sets are the distinct shingles of 5 words (split at blanks, tabs and line ends; A-Z lower-cased); a text of fewer words
    gives its whole sequence. Linked are documents with 100 * intersection >= 75 * union; component_id is the smallest
    doc_id that links lead to; kept is doc_id = component_id. Null and empty texts have n_shingles 0 and no links. A row
    without an id is linked with nothing: component_id null, kept true. Rows that repeat an id are one document; extra
    columns are not read; an empty table gives an empty one.

    Documents with equal sets fold into one representative first. Representatives that agree in one of 32 bands of 4 slots
    are candidates (a pair at the threshold is missed once in 200,000), and every candidate is looked at on its full sets, or
    joined to its group already. In each bucket all members are held against its most central member, the one whose buckets
    are largest; then, for some rounds, those not in its group against a member that is drawn; then every pair of the bucket
    whose ends are still in different groups is held against each other, block by block. Blocks are bounded by their bytes; no
    bucket is capped, and all are treated alike.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    signed = written(signatures(rows))
    some = signed.where("id IS NOT NULL AND n > 0")
    classes = written(some.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("n").alias("n")))
    banded = some.join(classes.select(F.col("rep").alias("id"), "d1", "d2"), ["id", "d1", "d2"], "left_semi").select("id", "n", "size", F.explode("bands").alias("bucket"))
    banded = banded.groupBy("id", "n", "bucket").agg(F.max("size").alias("size"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    met = written(banded.join(shared, "bucket"))
    central = met.groupBy("id").agg(F.sum("members").alias("weight"))
    ranked = met.join(central, "id")
    middle = ranked.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("id")).alias("low"), "n")).alias("m"))
    pivots = middle.select("bucket", (-F.col("m.low")).alias("pivot"), F.col("m.n").alias("pivot_n"))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    first = checkpointed(met.join(pivots, "bucket").where(F.col("id") != F.col("pivot")).where(fits(F.col("n"), F.col("pivot_n"))).select(*pair("id", "pivot")).distinct())
    texts = written(rows.join(met.select("id").distinct(), "id", "left_semi"))
    groups = components(verified(first, texts).union(same_document(some, classes)))
    tested, rest = first, met.select("bucket", "id", "n", "size")
    for k in range(ROUNDS + 1):
        rest = written(spread(rest, groups, "bucket", "id", "n", "size"))
        if k < ROUNDS:
            drawn = rest.groupBy("bucket").agg(F.max(F.struct(F.xxhash64("id", F.lit(k)).alias("draw"), *rest.columns)).alias("m")).select("m.*")
            pairs = rest.alias("x").join(drawn.alias("y"), F.col("x.bucket") == F.col("y.bucket")).where("x.component <> y.component").where(fits(F.col("x.n"), F.col("y.n")))
            pairs = checkpointed(pairs.select(*pair("x.id", "y.id")).distinct().join(tested, ["a", "b"], "left_anti"))
            tested, more = tested.union(pairs), verified(pairs, texts)
        else:
            more = blocks_verified(parted(rest), texts)
        if not more.isEmpty():
            groups = components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
        rest = rest.drop("component")
    home = classes.join(groups, F.col("rep") == F.col("id"), "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    linked = signed.where("id IS NOT NULL AND n > 0").join(home, ["d1", "d2"]).select("id", "n", "component_id")
    alone = signed.where("id IS NULL OR n = 0").select("id", "n", F.col("id").alias("component_id"))
    out = linked.union(alone)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", (F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"))


#: Ids up to this number (8 bytes each) are broadcast to drop their rows; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, in its columns, with one document of each group of near_duplicates(): the one of the smallest id. Of rows that repeat an id, one stays; rows without an id all stay."""
    mark = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    key = F.col(f"`{id_col}`").cast("long")
    go = written(near_duplicates(docs, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct())
    own = docs.where(key.isNotNull())
    again = written(own.groupBy(key.alias("__again")).agg(F.count("*").alias("n")).where("n > 1").select("__again"))
    out = docs.join(mark(go), key == F.col("__gone"), "left_anti")
    if again.isEmpty():
        return out
    twice = out.join(again, key == F.col("__again"), "left_semi")
    return out.join(mark(again), key == F.col("__again"), "left_anti").unionByName(twice.dropDuplicates([id_col]))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
