"""Vectorised text kernels used inside Arrow tasks.

Documents arrive as Arrow batches.  ``slices`` cuts a batch into runs of whole
documents of bounded size, and the kernels work on the run's bytes at once.
A word is ``[^\\x20\\x09-\\x0D]+``; none of those separators occurs inside a
UTF-8 sequence, so words can be found on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
STEP = np.uint64(0xD6E8FEB86659FD93)
#: Odd multipliers for the words of an n-gram, by their place in it.
PLACE = mix(np.arange(11, 43, dtype=np.uint64)) | np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 1 << 16), STEP, dtype=np.uint64)
        p[0] = 1
        _powers = np.cumprod(p)
    return _powers


@dataclass
class Run:
    """Whole documents whose bytes lie side by side: document i is data[offsets[i]:offsets[i + 1]]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8")


def slices(column, most: int = SLICE_BYTES) -> Iterator[Run]:
    """Runs of whole texts of an Arrow string column; null is the empty text."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = pc.fill_null(arr, "")
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    n = len(arr)
    if not n:
        return
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[arr.offset : arr.offset + n + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield Run(i, whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


@dataclass
class Words:
    """start, end: byte positions; hash: 64 bits; first[i]: index of document i's first word (len docs + 1)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def hash_spans(data: np.ndarray, keep: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hashes of consecutive non-empty spans, whose bytes are data[keep] in order."""
    if not len(lens):
        return np.zeros(0, np.uint64)
    body = data[keep]
    begin = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=begin[1:])
    place = np.arange(len(body), dtype=np.int64) - np.repeat(begin, lens)
    vals = BYTE_CODE[body] * powers(int(lens.max()) + 1)[place]
    return mix(np.add.reduceat(vals, begin) ^ lens.astype(np.uint64))


def words(run: Run, lower: bool = False) -> Words:
    data = LOWER[run.data] if lower else run.data
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(0, np.uint64), np.zeros(len(run) + 1, np.int64))
    white = WHITE[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = white[:-1]
    edge = run.offsets[:-1][run.offsets[:-1] < n]
    before[edge] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = white[1:]
    after[edge[edge > 0] - 1] = True
    inside = ~white
    start = np.flatnonzero(inside & before)
    end = np.flatnonzero(inside & after) + 1
    return Words(start, end, hash_spans(data, inside, end - start), np.searchsorted(start, run.offsets))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place of h on; len(h) - n + 1 values."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * PLACE[k]
    return mix(out)


def shingles(h: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct n-word shingle hashes of a document; with fewer words, its whole sequence as one."""
    if not len(h):
        return h
    if len(h) < n:
        k = np.uint64(len(h))
        return mix((h * PLACE[16 : 16 + len(h)]).sum(dtype=np.uint64, keepdims=True) ^ k)
    return np.unique(ngrams(h, n))


def counts_in(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many flags are set between consecutive edges."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]
