"""Numpy routines over the UTF-8 buffers of Arrow batches: word spans, word and shingle hashes.

All of them work on a chunk of whole documents laid end to end (`data`, `offsets`), so that their memory follows the
chunk and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse modulo 2**64, to the powers 0 .. n - 1."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values, sorted."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def chunks(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets within them) of runs of whole documents of up to `most` bytes; a longer
    document makes a run of its own. Nulls are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word, in order."""
    inside = ~_SPACE[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    after[-1:], after[:-1] = False, inside[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets[1:], starts, "right")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words with A-Z lower-cased: equal for equal words wherever they stand."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingles(words: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): document i has hashes[bounds[i]:bounds[i + 1]], repeats included.

    A document of fewer than k words has one shingle, its whole word sequence; one without words has none.
    """
    counts = np.bincount(doc, minlength=n_docs).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(made)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first[:-1], made)  # the word where each shingle starts
    size = np.repeat(np.minimum(counts, k), made)
    total = size.astype(U64) * U64(0xD6E8FEB86659FD93)
    for j in range(k):
        on = size > j
        factor = U64(pow(_BASE, 3 * j + 1, 1 << 64))
        if on.all():
            total += words[at + j] * factor
        else:
            total[on] += words[at[on] + j] * factor
    return mix(total), bounds


class MinMax:
    """Min-max hashing: of every permutation both the least and the greatest value are kept, so that a signature of
    2 * n values takes n hash evaluations an element. Both ends agree between two sets with the probability of their
    Jaccard similarity."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        self.bands, self.rows = bands, rows
        rng = np.random.default_rng(seed)
        n = (bands * rows + 1) // 2
        self.a = rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, n, dtype=np.uint32)
        self.order = rng.permutation(2 * n)[: bands * rows]  # the two ends of one permutation go to different bands, mostly
        self.factor = rng.integers(1, 2**63, rows, dtype=np.uint64) * U64(2) + U64(1)
        self.shift = rng.integers(1, 2**63, bands, dtype=np.uint64)

    def keys(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """int64[documents with elements, bands] of band keys; documents without elements are left out."""
        starts = bounds[:-1][np.diff(bounds) > 0]
        if not len(starts):
            return np.zeros((0, self.bands), np.int64)
        x = (hashes >> U64(32)).astype(np.uint32)
        n = len(self.a)
        ends = np.empty((2 * n, len(starts)), np.uint32)
        for i in range(n):
            v = x * self.a[i] + self.b[i]
            ends[i] = np.minimum.reduceat(v, starts)
            ends[n + i] = np.maximum.reduceat(v, starts)
        picked = ends[self.order].astype(U64).reshape(self.bands, self.rows, -1)
        return mix((picked * self.factor[None, :, None]).sum(axis=1, dtype=U64) + self.shift[:, None]).T.view(np.int64)


def lists(rows: np.ndarray, where: np.ndarray, n: int) -> pa.ListArray:
    """A list<int64> array of n rows: rows[i] at where[i], empty lists elsewhere."""
    sizes = np.zeros(n, np.int32)
    sizes[where] = rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.ascontiguousarray(rows).reshape(-1)))
