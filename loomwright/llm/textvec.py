"""Column-at-a-time text kernels: words, hashes and windows of many documents as NumPy arrays.

A batch of texts is cut into slabs of about `SLAB` bytes (a longer document is a slab of its own), so
that the 8-byte temporaries of a kernel stay bounded by the slab and not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLAB = 1 << 17
U = np.uint64
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1, 0xD6E8FEB86659FD93 | 1)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, which: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, or those of the inverse of the (odd) base."""
    have = _powers.get((which, inverse))
    if have is None or len(have) <= n:
        base = _BASES[which] if not inverse else pow(_BASES[which], -1, 1 << 64)
        size = max(n + 1, 4096)
        out = np.ones(size, U)
        done = 1
        while done < size:  # doubling: a block is the block before it times a power
            step = min(done, size - done)
            out[done : done + step] = out[:step] * U(pow(base, done, 1 << 64))
            done += step
        _powers[which, inverse] = have = out
    return have


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers with full avalanche."""
    h = h + U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def prefix(values: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums S with S[j] - S[i] = sum of values[k] * base**k over i <= k < j, modulo 2**64."""
    out = np.empty(len(values) + 1, U)
    out[0] = 0
    np.cumsum(values * powers(len(values), which)[: len(values)], out=out[1:])
    return out


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """Hashes of the ranges [start, end): equal for equal contents, wherever they stand."""
    return (sums[end] - sums[start]) * powers(len(sums), which, True)[start]


class Slab:
    """Some whole documents: `data` their UTF-8 bytes, `off` where each begins (one more at the end), `first` the first one's row."""

    def __init__(self, data: np.ndarray, off: np.ndarray, first: int):
        self.data, self.off, self.first = data, off, first
        self._words = None

    def __len__(self) -> int:
        return len(self.off) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words in `data`, and for each document the number of its first one (one more at the end)."""
        if self._words is None:
            d, off = self.data, self.off
            solid = ~((d == 32) | ((d - np.uint8(9)) < 5))
            before = np.empty(len(d) + 1, bool)
            before[0] = False
            before[1:] = solid
            before[off] = False  # a document's first byte follows no word
            starts = np.flatnonzero(solid & ~before[:-1])
            after = np.empty(len(d) + 1, bool)
            after[:-1] = solid
            after[-1] = False
            after[off] = False
            ends = np.flatnonzero(solid & ~after[1:]) + 1
            self._words = starts, ends, np.searchsorted(starts, off)
        return self._words

    def word_hashes(self) -> np.ndarray:
        starts, ends, _ = self.words()
        return mix(ranges(prefix(self.data.astype(U) + U(1), 0), starts, ends, 0)) ^ (ends - starts).astype(U)


def windows(values: np.ndarray, k: int, which: int) -> np.ndarray:
    """Hash of every run of k consecutive values: result i covers values[i:i+k]. Runs may cross documents; see `inside`."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    s = prefix(values, which)
    return mix((s[k:] - s[:-k]) * powers(len(s), which, True)[:n], which)


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Starts of the runs of k items that stay within one document; `first` as `Slab.words()` gives it."""
    total = int(first[-1]) - k + 1
    if total <= 0:
        return np.zeros(0, np.int64)
    ok = np.ones(total, bool)
    if k > 1:
        for x in first[1:-1]:  # starts less than k before a boundary
            ok[max(0, x - k + 1) : x] = False
    return np.flatnonzero(ok)


def slabs(texts: pa.Array | pa.ChunkedArray, size: int = SLAB) -> Iterator[Slab]:
    """The slabs of a text column; null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if len(texts) == 0:
        return
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(off, off[row] + size, "right")) - 1)
        yield Slab(raw[off[row] : off[stop]], off[row : stop + 1] - off[row], row)
        row = stop
