"""Prefix-free parsing of byte texts into phrases.

A gram is 16 bytes; its rolling hash decides where triggers stand: the trigger of a start is the least
hash among the next `REACH` grams (the leftmost of equals). A phrase is the run of starts that share a
trigger, with the `SIZE` - 1 bytes behind its last start, so every string of `SIZE` bytes lies whole in the one
phrase of its start, and equal strings have their trigger at the same offset, wherever they stand.
"""

from __future__ import annotations

import numpy as np

from .textvec import Slab, U, mix, powers, prefix

SIZE, REACH, GRAM = 200, 96, 16
#: Bytes from the trigger on that every string of the phrase holds.
RIGHT = SIZE - REACH + 1


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Place of the least key of keys[i : i + width] for every i that has a whole window; keys are distinct enough or ties go left."""
    n = len(keys) - width + 1
    pad = -len(keys) % width
    k = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max, U)]).reshape(-1, width)
    before = np.minimum.accumulate(k, axis=1).ravel()  # least from the block's start to here
    after = np.minimum.accumulate(k[:, ::-1], axis=1)[:, ::-1].ravel()  # least from here to the block's end
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


class Parse:
    """Phrases of one slab: `start` .. `stop` are their runs of starts (stop excluded), `doc` their documents."""

    def __init__(self, slab: Slab):
        d = slab.data
        n = len(d)
        empty = np.zeros(0, np.int64)
        self.sums = None
        self.start = self.stop = self.trigger = self.doc = empty
        if n < SIZE:
            return
        self.sums = sums = prefix(d.astype(U) + U(1), 0)
        grams = n - GRAM + 1
        h = mix((sums[GRAM:] - sums[:-GRAM]) * powers(n + 1, 0, True)[:grams])
        keys = (h & U(0xFFFFFFFF00000000)) | np.arange(grams, dtype=U)  # ties of the upper half go left
        at = (sliding_argmin(keys, REACH) & U(0xFFFFFFFF)).astype(np.int64)
        starts = len(at) - (SIZE - REACH - GRAM + 1)  # those that have SIZE bytes ahead
        at = at[:starts]
        # starts whose SIZE bytes stay in their document
        sizes = np.diff(slab.off)
        doc = np.repeat(np.arange(len(sizes)), sizes)[:starts]
        ok = np.arange(starts) + SIZE <= slab.off[doc + 1]
        new = np.empty(starts, bool)
        new[0] = True
        new[1:] = (at[1:] != at[:-1]) | (ok[1:] != ok[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], starts)
        good = ok[begin]
        self.start, self.stop = begin[good], end[good]
        self.trigger = at[self.start]
        self.doc = doc[self.start]

    def hashes(self, which: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Of each phrase, the hash of the RIGHT bytes at its trigger and that of the whole phrase."""
        inv = powers(len(self.sums), 0, True)
        t, a, b = self.trigger[which], self.start[which], self.stop[which] + SIZE - 1
        right = mix((self.sums[t + RIGHT] - self.sums[t]) * inv[t], 1)
        whole = mix(((self.sums[b] - self.sums[a]) * inv[a]) ^ ((b - a).astype(U) << U(48)), 2) ^ mix(right + (t - a).astype(U), 3)
        return right, whole


def string_key(at: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Hash of the SIZE bytes at each of the places `at`; `sums` as `Parse` has it."""
    return mix((sums[at + SIZE] - sums[at]) * powers(len(sums), 0, True)[at], 4)


def bucket_sums(slab: Slab) -> np.ndarray:
    return prefix(slab.data.astype(U) + U(1), 1)


def bucket_key(at: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Another hash of the same, independent of `string_key`; `sums` from `bucket_sums`."""
    return mix((sums[at + SIZE] - sums[at]) * powers(len(sums), 1, True)[at], 5)


def dense(keys: np.ndarray) -> np.ndarray:
    """Rank of every key, equal keys alike."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    new = np.concatenate(([False], sorted_keys[1:] != sorted_keys[:-1]))
    out = np.empty(len(keys), U)
    out[order] = np.cumsum(new).astype(U)
    return out


def suffix_ranks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes at `starts` in the suffix array of `data`, taken to SIZE bytes; equal strings share a rank.

    Prefix doubling: ranks by 8 bytes, then by 16, 32, 64 and 128; two of the last make SIZE."""
    padded = np.concatenate([data, np.zeros(SIZE, np.uint8)])
    n = len(data)
    key = np.zeros(n, U)
    for k in range(8):
        key = (key << U(8)) | padded[k : k + n]
    rank = dense(key)
    for h in (8, 16, 32, 64):
        ahead = np.zeros(n, U)
        ahead[: n - h] = rank[h:]
        rank = dense((rank << U(32)) | ahead)
    return dense((rank[starts] << U(32)) | rank[starts + SIZE - 128])
