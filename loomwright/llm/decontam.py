"""Operator 10: benchmark decontamination by SimHashed item-sized windows.

Words are lower-cased runs of letters, digits and non-ASCII bytes. For every benchmark item, windows of
its own number of words slide over every text; a window leaks the item when the weighted Jaccard
similarity of their five-word shingles, each weighing its number of occurrences, is 0.8 or more. A text
shorter than the item is its own one window.

A window of m shingles that reaches the similarity s to n has at least (m + n) s / (1 + s) shingles of the item, so windows with
fewer shingles of any item are passed over at once (a running count; nothing is lost). The others get a
128-bit SimHash of their weighted shingles, which is looked up in a multi-index: the bits form 4 blocks of 32,
each of two halves. Of two fingerprints within `RADIUS`, the first block differs by a quarter of it at most or another by less than
that (else all would add up to more), and likewise the block's halves: so a lookup walks the stored halves near its own, keeps what the block
confirms (under 1 % of unrelated fingerprints), and misses none. Candidates within the radius are verified by the exact similarity.

The benchmark is the stated query set: it is read in blocks of at most `BLOCK_BYTES` of text (an item that is larger alone
is a block by itself), and each block, of that proven size, goes to all tasks while all documents stream past it.

Defined results: items of fewer than five words have no shingle and match nothing; null texts have no
words; a null doc_id or item_id is reported as null; equal items are reported each; repeated documents
are reported each; empty tables give an empty result; only the named columns are read, so others may bear any name.
ids may be of any type that Arrow carries; texts and items may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut
from .textvec import Slab, U, mix, slabs, windows

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 32
BLOCK_BYTES = 16 << 20
_FOLD = np.arange(256, dtype=np.uint8)
for _b in range(128):
    _FOLD[_b] = ord(chr(_b).lower()) if chr(_b).isalnum() else 32


def folded(slab: Slab) -> Slab:
    """The slab with ASCII letters in lower case and other ASCII characters blank."""
    return Slab(_FOLD[slab.data], slab.off, slab.first)


def signs(shingles: np.ndarray) -> np.ndarray:
    """The 128 bits of each shingle as -1 and 1."""
    both = np.stack([mix(shingles, 21), mix(shingles, 22)], axis=1).view(np.uint8)
    return np.unpackbits(both, axis=1).astype(np.int32) * 2 - 1


def fingerprints(shingles: np.ndarray, starts: np.ndarray, n: int, step: int = 16384) -> np.ndarray:
    """SimHashes of the windows of n shingles at `starts` (ascending); a shingle weighs as often as it occurs. Memory is that of `step` shingles, whatever n."""
    out = np.zeros((len(starts), 2), U)
    # windows further apart than n shingles are summed anew, others slide
    groups = np.split(np.arange(len(starts)), np.flatnonzero(np.diff(starts) > n) + 1) if len(starts) else []
    for group in groups:
        at, last = int(starts[group[0]]), int(starts[group[-1]])
        if last + n - at <= step:
            sums = np.zeros((last + n - at + 1, 128), np.int32)
            np.cumsum(signs(shingles[at : last + n]), axis=0, out=sums[1:])
            out[group] = np.packbits(sums[starts[group] - at + n] - sums[starts[group] - at] >= 0, axis=1).view(U)
            continue
        total = np.zeros(128, np.int64)
        for i in range(at, at + n, step):
            total += signs(shingles[i : min(i + step, at + n)]).sum(axis=0)
        out[group[0]] = np.packbits(total >= 0).view(U)
        for i in range(at, last, step):
            j = min(i + step, last)
            sums = total + np.cumsum(signs(shingles[i + n : j + n]) - signs(shingles[i:j]), axis=0, dtype=np.int64)
            total = sums[-1]
            mine = group[(starts[group] > i) & (starts[group] <= j)]
            out[mine] = np.packbits(sums[starts[mine] - i - 1] >= 0, axis=1).view(U)
    return out


class MultiIndex:
    """Fingerprints by the halves of four 32-bit blocks."""

    BLOCKS = 4

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.halves = np.ascontiguousarray(prints).view(np.uint16).reshape(len(prints), 2 * self.BLOCKS)
        self.blocks = np.ascontiguousarray(prints).view(np.uint32).reshape(len(prints), self.BLOCKS)
        self.values = [np.unique(self.halves[:, i], return_inverse=True) for i in range(2 * self.BLOCKS)]
        self.near: dict[tuple[int, int], np.ndarray] = {}
        self.held = 0
        self.radii = [RADIUS // self.BLOCKS - (i > RADIUS % self.BLOCKS) for i in range(self.BLOCKS)]

    def _half(self, i: int, value: int) -> np.ndarray:
        """The stored fingerprints whose half i is near the value; looked up once per value."""
        found = self.near.get((i, value))
        if found is None:
            r = self.radii[i // 2]
            values, which = self.values[i]
            found = np.flatnonzero((np.bitwise_count(values ^ np.uint16(value)) <= r // 2 - (i % 2 > r % 2))[which])
            if self.held > 4_000_000:  # places, some 32 MB
                self.near.clear()
                self.held = 0
            self.near[i, value] = found
            self.held += len(found) + 16
        return found

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, stored one) of all that agree in some block as far as the radius asks for."""
        halves = np.ascontiguousarray(prints).view(np.uint16).reshape(len(prints), 2 * self.BLOCKS)
        blocks = np.ascontiguousarray(prints).view(np.uint32).reshape(len(prints), self.BLOCKS)
        pairs = []
        for i in range(2 * self.BLOCKS):
            values, which = np.unique(halves[:, i], return_inverse=True)
            near = [self._half(i, v) for v in values.tolist()]
            sizes = np.array([len(x) for x in near], np.int64)
            n = sizes[which]  # of every fingerprint, the stored halves near its own
            q = np.repeat(np.arange(len(prints)), n)
            at = np.repeat((np.cumsum(sizes) - sizes)[which] - (np.cumsum(n) - n), n) + np.arange(len(q))
            item = np.concatenate(near)[at]
            ok = np.bitwise_count(self.blocks[item, i // 2] ^ blocks[q, i // 2]) <= self.radii[i // 2]
            pairs.append(q[ok] * len(self.prints) + item[ok])
        return np.divmod(np.unique(np.concatenate(pairs)), len(self.prints))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, stored one) of all within the radius."""
        q, item = self.candidates(prints)
        ok = np.bitwise_count(self.prints[item] ^ prints[q]).sum(axis=1, dtype=np.int64) <= RADIUS
        return q[ok], item[ok]


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of lesser over sum of greater multiplicities."""
    va, ca = np.unique(a, return_counts=True)
    vb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[ia], cb[ib]).sum())
    return both / (len(a) + len(b) - both)


class Items:
    """A block of benchmark items, ready to be matched."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        self.ids = ids
        self.shingles: list[np.ndarray] = []
        for slab in slabs(pa.array(texts, pa.string())):
            slab = folded(slab)
            first, hashes = slab.words()[2], slab.word_hashes()
            self.shingles += [windows(hashes[first[d] : first[d + 1]], SHINGLE, 1) for d in range(len(slab))]
        self.by_size: dict[int, tuple[list[int], MultiIndex]] = {}
        for n in sorted({len(s) for s in self.shingles if len(s)}):
            of = [i for i, s in enumerate(self.shingles) if len(s) == n]
            self.by_size[n] = of, MultiIndex(np.concatenate([fingerprints(self.shingles[i], np.zeros(1, np.int64), n) for i in of]))
        self.least = ceil(min(self.by_size, default=0) * SIMILARITY - 1e-9)
        table = np.unique(np.concatenate(self.shingles)) if self.by_size else np.zeros(0, U)
        self.table = table
        self.map = np.zeros(1 << 20, bool)
        self.map[(table >> U(44)).astype(np.int64)] = True

    @staticmethod
    def need(size: int, n: int) -> int:
        """The least number of common shingles with which a window of `size` shingles and an item of n reach the similarity."""
        return ceil((size + n) * SIMILARITY / (1 + SIMILARITY) - 1e-9)

    def known(self, shingles: np.ndarray) -> np.ndarray:
        """Places of shingles that some item has."""
        near = np.flatnonzero(self.map[(shingles >> U(44)).astype(np.int64)])
        if not len(near):
            return near
        at = np.searchsorted(self.table, shingles[near])
        at[at == len(self.table)] = 0
        return near[self.table[at] == shingles[near]]

    def leaks(self, slabs: Iterable[Slab]) -> Iterator[tuple[int, int, float, int]]:
        """(row, item, similarity, first word) of the best window of every item that a document leaks. Fingerprints of many documents are looked up together."""
        held: dict[int, list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]] = {}
        n_held = 0
        for slab in slabs if self.by_size else ():
            slab = folded(slab)
            first = slab.words()[2]
            grams = windows(slab.word_hashes(), SHINGLE, 1)
            known = self.known(grams)
            if not len(known):
                continue
            doc = np.searchsorted(first, known, "right") - 1
            for d in np.unique(doc):
                total = max(0, int(first[d + 1] - first[d]) - SHINGLE + 1)
                mine = known[doc == d] - first[d]
                mine = mine[mine < total]
                if len(mine) < self.least:
                    continue
                own = grams[first[d] : first[d] + total]
                count = np.zeros(total + 1, np.int64)
                count[mine + 1] = 1
                count = np.cumsum(count)
                for n in self.by_size:
                    size = min(n, total)
                    need = self.need(size, n)
                    if len(mine) < need:
                        continue
                    starts = np.flatnonzero(count[size:] - count[:-size] >= need)
                    if len(starts):
                        held.setdefault(n, []).append((slab.first + int(d), size, own, starts, fingerprints(own, starts, size)))
                        n_held += len(starts)
                if n_held > 65536:
                    yield from self._verified(held)
                    held, n_held = {}, 0
        yield from self._verified(held)

    def _verified(self, held: dict) -> Iterator[tuple[int, int, float, int]]:
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for n, parts in held.items():
            of, index = self.by_size[n]
            ends = np.cumsum([len(p[3]) for p in parts])
            q, k = index.within(np.concatenate([p[4] for p in parts]))
            which = np.searchsorted(ends, q, "right")
            for p, at, item in zip(which, q - np.concatenate(([0], ends))[which], k):
                row, size, own, starts, _ = parts[p]
                s, item = int(starts[at]), of[item]
                sim = weighted_jaccard(own[s : s + size], self.shingles[item])
                have = best.get((row, item))
                if sim >= SIMILARITY and (have is None or sim > have[0] or sim == have[0] and s < have[1]):
                    best[row, item] = sim, s
        for (row, item), (sim, s) in sorted(best.items()):
            yield row, item, sim, s


def blocks_of(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in blocks whose size is bounded before they are fetched."""
    rows = benchmark.select("item_id", "text").withColumn("_size", (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).cast("long"))
    total = rows.agg(F.sum("_size")).first()[0] or 0
    if not total:
        return
    # running sizes within hash buckets: a block begins where half of BLOCK_BYTES is full
    bucket = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, total // BLOCK_BYTES)))
    before = F.sum("_size").over(Window.partitionBy("_bucket").orderBy("_size", "item_id", "text").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_bucket", bucket).withColumn("_block", F.floor(F.coalesce(before, F.lit(0)) / (BLOCK_BYTES // 2)).cast("long"))
    rows = cut(rows)
    for b in rows.select("_bucket", "_block").distinct().orderBy("_bucket", "_block").collect():
        got = rows.filter((F.col("_bucket") == b[0]) & (F.col("_block") == b[1])).orderBy("item_id", "text").collect()
        yield Items([r["item_id"] for r in got], [r["text"] for r in got])


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, first_word (0-based) of every item that a document leaks."""
    schema = T.StructType([docs.schema["doc_id"], benchmark.schema["item_id"], T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType())])
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)

    def scan(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(items.leaks(slabs(batch.column(1))))
                rows = pa.array([r for r, *_ in found], pa.int64())
                cols = [batch.column(0).take(rows), pa.array([items.ids[i] for _, i, *_ in found], item_type), pa.array([round(s, 6) for *_, s, _ in found], pa.float64()), pa.array([w for *_, w in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, schema.names)

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    out = None
    for items in blocks_of(benchmark):
        out = scan(items) if out is None else out.union(scan(items))
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with the columns that came in."""
    names, schema = docs.columns, docs.schema

    def scan(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, *_ in items.leaks(slabs(batch.column(names.index("text")))):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        return run

    for items in blocks_of(benchmark):
        docs = docs.mapInArrow(scan(items), schema)
    return docs
