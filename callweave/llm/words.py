"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text taken at a time; a longer text is taken alone.
CHUNK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes: all but blanks and tab to carriage return.
UNBLANK = np.ones(256, bool)
UNBLANK[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes: digits, a to z, and all beyond ASCII (after lower-casing).
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = True

BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
PLACE = np.uint64(0x2545F4914F6CDD1D)
#: The first 0 ... 8 bytes of 8.
TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed)) | np.uint64(1)


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each run of bytes. Runs of up to 8 bytes and one length have one each; of a longer one, each 8 bytes are mixed with a key of
    their place before they are summed, so that no arithmetic between places makes different words alike."""
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    h = mix((eight[start] & TAIL[np.minimum(size, 8)]) ^ PLACE)
    more = np.flatnonzero(size > 8)
    if len(more):
        count = (size[more] - 1) // 8
        place = ragged(count) + 1
        at = np.repeat(start[more], count) + 8 * place
        left = np.minimum(np.repeat(end[more], count) - at, 8)
        parts = mix((eight[at] & TAIL[left]) ^ mix(place.astype(np.uint64) * np.uint64(BASE) + PLACE))
        h[more] += np.add.reduceat(parts, np.concatenate([[0], np.cumsum(count)[:-1]]))
    return mix(h + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """rows: the row of each text; ptr: where each text's words begin, and the end; start, end: bytes of each word in data; hash: 64 bits of each lower-cased word."""

    first: int
    data: np.ndarray
    text: np.ndarray
    ptr: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def n(self) -> np.ndarray:
        return np.diff(self.ptr)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), self.n)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each text begins in them."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(texts: pa.Array, kind: np.ndarray = UNBLANK, size: int = CHUNK) -> Iterator[Words]:
    """The words of the texts, some rows at a time; every row comes in exactly one chunk, whole."""
    data, at = buffers(texts)
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + size, "right")) - 1)
        yield split(low, data[at[low] : at[high]], at[low : high + 1] - at[low], kind)
        low = high


def split(first: int, data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> Words:
    size = len(data)
    data = LOWER[data]
    inside = kind[data]
    before = np.empty(size, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < size]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(size, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(first, data, at, np.searchsorted(start, at), start, end, word_hash(data, start, end))


SHINGLE = constants(64, 5)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64 bits of each run of k words, and where each text's begin; a text of fewer words, but not none, gives its whole sequence."""
    n = w.n
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    ptr = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(ptr[-1], np.uint64)
    long = n >= k
    take = np.repeat(w.ptr[:-1][long], count[long]) + ragged(count[long])
    put = np.repeat(ptr[:-1][long], count[long]) + ragged(count[long])
    acc = np.zeros(len(take), np.uint64)
    for j in range(k):
        acc += w.hash[take + j] * SHINGLE[j]
    out[put] = mix(acc)
    for r in np.flatnonzero((n > 0) & ~long):
        own = w.hash[w.ptr[r] : w.ptr[r + 1]]
        out[ptr[r]] = mix((own * SHINGLE[: len(own)]).sum(keepdims=True) + np.uint64(len(own)) * SHINGLE[-1])[0]
    return out, ptr


def ragged(count: np.ndarray) -> np.ndarray:
    """0 ... c-1 for each c in count, one after the other."""
    total = int(count.sum())
    return np.arange(total) - np.repeat(np.cumsum(count) - count, count)


def distinct(values: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted, once each."""
    parts = [np.unique(values[a:b]) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
    return np.concatenate(parts) if parts else values[:0], np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)
