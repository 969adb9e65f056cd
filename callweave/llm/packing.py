"""Token ids packed into rows of fixed length: best fit, longest piece first, with a segment tree over what rows have left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import tokenize, workers
from callweave.session import table

LENGTH = 2048
#: Tokens packed together: some 8 MB. A longer document is packed alone with what came before it.
UNIT_TOKENS = 1 << 22


class Capacities:
    """A segment tree over capacities 0..most: tells in O(log most) the least capacity, at least as large as asked for, that some row has left."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.has = [False] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, row: int, left: int) -> None:
        self.rows[left].append(row)
        v = self.leaves + left
        while v and not self.has[v]:
            self.has[v] = True
            v >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, its capacity), taken out, or None."""
        has, v = self.has, self.leaves + need
        if not has[v]:
            while v > 1 and (v & 1 or not has[v + 1]):
                v >>= 1
            if v <= 1:
                return None
            v += 1
            while v < self.leaves:
                v = 2 * v if has[2 * v] else 2 * v + 1
        left = v - self.leaves
        row = self.rows[left].pop()
        if not self.rows[left]:
            has[v] = False
            while v > 1 and not has[v ^ 1]:
                v >>= 1
                has[v] = False
        return row, left


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of pieces, by number: pieces by falling size, each into the row with least room that holds it."""
    rows: list[list[int]] = []
    tree = Capacities(length)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = tree.take(sizes[k])
        row, left = found or (len(rows), length)
        if not found:
            rows.append([])
        rows[row].append(k)
        if left > sizes[k]:
            tree.put(row, left - sizes[k])
    return rows


def read(b: pa.RecordBatch, rows: int = 128) -> Iterator[tuple[object, str]]:
    """(id, text) of a batch, of which only some rows are Python objects at a time."""
    for lo in range(0, b.num_rows, rows):
        part = b.slice(lo, rows)
        yield from zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True)


def _packed(batches, tokenizer, length, unit, eos, pad):
    known = tokenize.ids(tokenizer)
    dtype = known.of.dtype
    end = b"" if eos is None else np.array([eos], dtype).tobytes()
    pieces: list[tuple[object, int, bytes]] = []
    held = 0

    def rows():
        wide = dtype.itemsize
        sizes = [len(x) // wide for _, _, x in pieces]
        out = best_fit(sizes, length)
        for k in range(0, len(out), 512):
            yield batch(out[k : k + 512], sizes)

    def batch(part, sizes):
        cu = [[0, *np.cumsum([sizes[i] for i in r]).tolist()] for r in part]
        blank = np.array([pad], dtype).tobytes()
        full = [b"".join(pieces[i][2] for i in r) for r in part]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([[pieces[i][0] for i in r] for r in part], pa.list_(kind)),
                pa.array([[pieces[i][1] for i in r] for r in part], pa.list_(pa.int64())),
                pa.array(cu, pa.list_(pa.int32())),
                pa.array([c[:-1] for c in cu], pa.list_(pa.int32())),
                pa.array([c[-1] for c in cu], pa.int32()),
                pa.array([x + blank * (length - c[-1]) for x, c in zip(full, cu, strict=True)], pa.binary()),
            ],
            ["doc_ids", "offsets", "cu_seqlens", "position_resets", "n_tokens", "ids"],
        )

    step = length * dtype.itemsize
    for b in batches:
        kind = b.column("id").type
        for i, t in read(b):
            data = known.ids(t)
            if not data:
                continue
            data += end
            pieces += [(i, k // dtype.itemsize, data[k : k + step]) for k in range(0, len(data), step)]
            held += len(data) // dtype.itemsize
            if held >= unit:
                yield from rows()
                pieces, held = [], 0
    if pieces:
        yield from rows()


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, unit: int = UNIT_TOKENS, eos: int | None = None, pad: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of a token id matrix: row_id, doc_ids, offsets, cu_seqlens, position_resets, n_tokens, ids.

    ids: `length` little-endian numbers of 2 bytes (4 for a vocabulary over 65,536), the last length - n_tokens of them `pad`.
    Segment s of a row is the tokens cu_seqlens[s] to cu_seqlens[s + 1] of ids: those of doc_ids[s] from token offsets[s] on;
    positions start again from 0 at each of position_resets. A document of more than `length` tokens, with its `eos`, is cut
    into pieces that are all there: put in order of offsets, they give it back. Pieces are packed within their partition, some
    `unit` tokens at a time, so nothing is shuffled and memory does not depend on the partition's size.

    Null and empty texts, and others without tokens, take no segment. A null id is a null in doc_ids. Repeated rows are packed
    as often as they come. Extra columns are not read; an empty table gives an empty one. How rows are filled depends on the
    partitions; what they hold does not.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kinds = f"doc_ids array<{rows.schema['id'].dataType.simpleString()}>, offsets array<long>, cu_seqlens array<int>, position_resets array<int>, n_tokens int, ids binary"
    out = workers.mapped(rows, lambda bs: _packed(bs, tokenizer, length, unit, eos, pad), kinds, holds=True)
    return out.select(F.monotonically_increasing_id().alias("row_id"), "*")


def matrix(rows: list, dtype: str = "<u2") -> np.ndarray:
    """The id matrix of collected rows of packed()."""
    return np.frombuffer(b"".join(bytes(r.ids) for r in rows), dtype).reshape(len(rows), -1)


def positions(row) -> np.ndarray:
    """Position of each token of a row within its segment."""
    out = np.arange(row.n_tokens)
    starts = np.asarray(row.position_resets)
    return out - np.repeat(starts, np.diff(row.cu_seqlens))


def segments(row, dtype: str = "<u2") -> Iterator[tuple[object, int, list[int]]]:
    """(document, offset, token ids) of each segment of a row."""
    ids = np.frombuffer(bytes(row.ids), dtype)
    for d, o, a, b in zip(row.doc_ids, row.offsets, row.cu_seqlens[:-1], row.cu_seqlens[1:], strict=True):
        yield d, o, ids[a:b].tolist()


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")), eos=2)
