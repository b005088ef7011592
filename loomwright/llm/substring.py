"""Operator 4: substring dedup by fixed-block anchors.

The reference side is cut into non-overlapping blocks of 25 words; any 50-word window holds one whole
block. The probe side looks every rolling 25-word window up among the blocks. A hit says that the window
stands in a document with a smaller id, and both sides extend it: the 50-word windows around hits, and
only those, meet by their own hash, and where one also starts in a document with a smaller id its words
are removed. Overlapping windows chain up to the maximal exact repeats.

Four passes, all linear: (1) blocks and probes by hash bucket, four bytes a probe; (2) hits, and the
owners of blocks that were hit; (3) windows around hits, each to its bucket, where the least id of each
window is known; (4) coverage. What repeats within one batch of documents is settled in the batch, so a
passage that very many documents share reaches a bucket once per batch. Nothing is collected or broadcast.

Windows are compared by a 64-bit hash plus the bucket's bits; a false repeat has odds of about one in
10**19 a pair. Defined results: null and empty texts have no words; texts under 50 words are kept whole;
rows of equal id are not smaller than each other, so both stay; a null id counts as the greatest; an empty
table gives an empty result; only doc_id and text are read, so other columns may bear any name; an id that is no
integer is a TypeError before anything runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .exchange import CELL, GATHER, Sieve, batch_of, bucket_stream, by_bucket, cells, ids_of, in_sorted, log2, long_id, runs, width
from .textvec import Slab, U, inside, slabs, windows

WINDOW, BLOCK = 50, 25
_REPLY = "id long, bucket int, hits binary"
_REPLY_ARROW = pa.schema([("id", pa.int64()), ("bucket", pa.int32()), ("hits", pa.binary())])


def _long(slab: Slab, k: int) -> np.ndarray:
    """Of the runs of k words inside documents, those in documents of WINDOW words or more."""
    first = slab.words()[2]
    at = inside(first, k)
    doc = np.searchsorted(first, at, "right") - 1
    return at[(first[doc + 1] - first[doc]) >= WINDOW]


def _replies(ids: np.ndarray, buckets: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of _REPLY from single hits; values keep their type."""
    if len(ids) == 0:
        return
    order = np.lexsort((buckets, ids))
    ids, buckets, values = ids[order], buckets[order], values[order]
    change = np.concatenate(([True], (ids[1:] != ids[:-1]) | (buckets[1:] != buckets[:-1])))
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(ids))
    for i in range(0, len(starts), 5000):
        s, e = starts[i : i + 5000], ends[i : i + 5000]
        yield pa.RecordBatch.from_arrays([pa.array(ids[s]), pa.array(buckets[s].astype(np.int32)), pa.array([values[a:b].tobytes() for a, b in zip(s, e)], pa.binary())], schema=_REPLY_ARROW)


class _Gather:
    """Items of many slabs (hash, document) until there are enough to pack. Documents are numbered in the order of their ids."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.hashes: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.marks: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.n = self.rows = 0

    def add(self, hashes: np.ndarray, docs: np.ndarray, marks: np.ndarray, ids: np.ndarray) -> None:
        self.hashes.append(hashes)
        self.docs.append(docs + self.rows)
        self.marks.append(marks)
        self.ids.append(ids)
        self.n += len(hashes)
        self.rows += len(ids)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        out = np.concatenate(self.hashes), np.concatenate(self.docs), np.concatenate(self.marks), np.concatenate(self.ids)
        self.clear()
        return out


def _shared(hashes: np.ndarray, docs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the items, those whose hash occurs more than once in the batch, and of these the ones to send on (one of the least id per hash)."""
    s = np.sort(hashes)
    twice = s[1:][s[1:] == s[:-1]]
    if len(twice) == 0:
        none = np.zeros(0, np.int64)
        return none, none
    items = np.flatnonzero(in_sorted(hashes, np.unique(twice)))
    order = items[np.lexsort((ids[docs[items]], hashes[items]))]
    return order, order[runs(hashes[order])[0]]


def _split(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and the 32 bits behind it."""
    return (h >> U(64 - bits)).astype(np.int32), ((h >> U(32 - bits)) & U(0xFFFFFFFF)).astype(np.uint32)


def _first_pass(bits: int):
    """Blocks (kind 0), probes (kind 1) and the hits that the batch itself settles (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _Gather()

        def flush() -> Iterator[pa.RecordBatch]:
            if not store.n:
                store.clear()
                return
            h, docs, block, ids = store.take()
            bucket, rest = _split(h, bits)
            items, least = _shared(h, docs, ids)
            keep = np.ones(len(h), bool)
            greatest = np.zeros(len(h), bool)
            out = []
            if len(items):
                first, n = runs(h[items])
                which = np.repeat(np.arange(len(first)), n)
                several = np.repeat(ids[docs[items[first + n - 1]]] != ids[docs[least]], n)  # not all of one id
                hit = np.sort(items[several])
                out += cells(bucket[hit], docs[hit], ids, rest[hit], 2)
                least_id = ids[docs[least]][which]
                # a block of a greater id goes on only if the least one's is no block
                blocks = items[block[items]]
                drop = items[ids[docs[items]] != least_id]
                keep[drop] = False
                # a probe of the greatest id goes on too: the owner of a block is marked by any greater id
                greatest[items[first + n - 1]] = True
                # blocks keep the least id among the blocks of a hash
                if len(blocks):
                    bf = blocks[runs(h[blocks])[0]]
                    extra = np.sort(bf[~keep[bf]])
                    out += cells(bucket[extra], docs[extra], ids, rest[extra], 0)
            b = np.flatnonzero(block & keep)
            out += cells(bucket[b], docs[b], ids, rest[b], 0)
            p = np.flatnonzero(keep | greatest)
            out += cells(bucket[p], docs[p], ids, rest[p], 1)
            for i in range(0, len(out), 16):
                yield batch_of(out[i : i + 16])

        for batch in batches:
            ids = ids_of(batch.column(0))
            for slab in slabs(batch.column(1)):
                first = slab.words()[2]
                at = _long(slab, BLOCK)
                if len(at) == 0:
                    continue
                doc = np.searchsorted(first, at, "right") - 1
                store.add(windows(slab.word_hashes(), BLOCK, 1)[at], doc, (at - first[doc]) % BLOCK == 0, ids[slab.first : slab.first + len(slab)])
                if store.n >= GATHER:
                    yield from flush()
        yield from flush()

    return run


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Probes against the blocks of their bucket: hits, and the owners of blocks that were hit."""
    at = None
    table = owner = was_hit = sieve = None
    pending: list[tuple[np.ndarray, np.ndarray]] = []

    def close() -> Iterator[pa.RecordBatch]:
        if was_hit is not None and was_hit.any():
            yield from _replies(owner[was_hit], np.full(int(was_hit.sum()), at, np.int32), table[was_hit])

    for bucket, kind, ids, counts, data in bucket_stream(batches):
        if bucket != at:
            yield from close()
            at, pending = bucket, []
            table = owner = was_hit = sieve = None
        values = np.frombuffer(data, np.uint32)
        each = np.repeat(ids, counts)
        if kind == 0:
            pending.append((values, each))
            continue
        if kind == 2:
            yield from _replies(each, np.full(len(each), bucket, np.int32), values)
            continue
        if sieve is None:
            v, o = (np.concatenate([x[i] for x in pending]) if pending else np.zeros(0, t) for i, t in ((0, np.uint32), (1, np.int64)))
            order = np.lexsort((o, v))
            first = runs(v[order])[0]
            table, owner = v[order][first], o[order][first]
            was_hit = np.zeros(len(table), bool)
            sieve, pending = Sieve(table), []
        item, place = sieve.find(values)
        more = each[item] > owner[place]
        item, place = item[more], place[more]
        was_hit[place] = True
        yield from _replies(each[item], np.full(len(item), bucket, np.int32), values[item])
    yield from close()


def _gathered(replies: DataFrame) -> DataFrame:
    return replies.groupBy("id").agg(F.collect_list(F.struct("bucket", "hits")).alias("hits"))


def _hit_set(hits, kind: type, shift: int) -> np.ndarray:
    """The sorted values bucket << shift | hit of one document's replies."""
    if not hits:
        return np.zeros(0, U)
    parts = [np.frombuffer(x["hits"], kind).astype(U) | (U(x["bucket"]) << U(shift)) for x in hits]
    return np.unique(np.concatenate(parts))


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", long_id(docs).alias("id"))


def _around(slab_hashes: np.ndarray, hits: np.ndarray, bits: int) -> np.ndarray:
    """Of one document (hashes of its words), the starts of the 50-word windows that hold a hit."""
    h = windows(slab_hashes, BLOCK, 1)
    hit = in_sorted(h >> U(32 - bits), hits)
    total = np.concatenate(([0], np.cumsum(hit)))
    n = len(slab_hashes) - WINDOW + 1
    return np.flatnonzero(total[WINDOW - BLOCK + 1 : WINDOW - BLOCK + 1 + n] > total[:n])


def _window_keys(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 64-bit hash of every 50-word window."""
    return (windows(hashes, WINDOW, 2) >> U(64 - bits)).astype(np.int32), windows(hashes, WINDOW, 1)


def _third_pass(bits: int):
    """The windows around hits: the least of each hash in the batch (kind 0), and those the batch settles (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _Gather()

        def flush() -> Iterator[pa.RecordBatch]:
            if not store.n:
                store.clear()
                return
            h, docs, bucket, ids = store.take()
            items, least = _shared(h, docs, ids)
            keep = np.ones(len(h), bool)
            out = []
            if len(items):
                _, n = runs(h[items])
                settled = np.sort(items[ids[docs[items]] != np.repeat(ids[docs[least]], n)])
                keep[items] = False
                keep[least] = True
                out += cells(bucket[settled], docs[settled], ids, h[settled], 1)
            p = np.flatnonzero(keep)
            out += cells(bucket[p], docs[p], ids, h[p], 0)
            for i in range(0, len(out), 16):
                yield batch_of(out[i : i + 16])

        for batch in batches:
            for slab, ids, hits in _with_hits(batch, np.uint32, 32):
                first, hashes = slab.words()[2], slab.word_hashes()
                for d in range(len(slab)):
                    w = hashes[first[d] : first[d + 1]]
                    if len(w) < WINDOW or len(hits[d]) == 0:
                        continue
                    at = _around(w, hits[d], bits)
                    bucket, key = _window_keys(w, bits)
                    store.add(key[at], np.zeros(len(at), np.int64), bucket[at], ids[d : d + 1])
                if store.n >= GATHER:
                    yield from flush()
        yield from flush()

    return run


def _with_hits(batch: pa.RecordBatch, kind: type, shift: int) -> Iterator[tuple[Slab, np.ndarray, list[np.ndarray]]]:
    """Slabs of (id, text, hits) rows with their ids and hit sets."""
    ids, all_hits = ids_of(batch.column(0)), batch.column(2)
    for slab in slabs(batch.column(1)):
        rows = range(slab.first, slab.first + len(slab))
        yield slab, ids[slab.first : slab.first + len(slab)], [_hit_set(all_hits[i].as_py(), kind, shift) for i in rows]


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket, the windows that also start in a document with a smaller id."""
    at, parts = None, []

    def close() -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        h, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.lexsort((ids, h))
        h, ids = h[order], ids[order]
        first, n = runs(h)
        more = ids > np.repeat(ids[first], n)
        yield from _replies(ids[more], np.full(int(more.sum()), at, np.int32), h[more])

    for bucket, kind, ids, counts, data in bucket_stream(batches):
        if bucket != at:
            yield from close()
            at, parts = bucket, []
        values, each = np.frombuffer(data, U), np.repeat(ids, counts)
        if kind == 1:
            yield from _replies(each, np.full(len(each), bucket, np.int32), values)
        else:
            parts.append((values, each))
    yield from close()


def _last_pass(bits: int, with_texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, texts = [], [], [], []
            ids, replies = batch.column(0), batch.column(2)
            for slab in slabs(batch.column(1)):
                starts, ends, first = slab.words()
                raw = slab.data.tobytes()
                hashes = None
                for d in range(len(slab)):
                    a, b = int(first[d]), int(first[d + 1])
                    removed = np.zeros(b - a, bool)
                    hits = replies[slab.first + d].as_py()
                    if hits and b - a >= WINDOW:
                        hashes = slab.word_hashes() if hashes is None else hashes
                        w = hashes[a:b]
                        bucket, key = _window_keys(w, bits)
                        got = np.zeros(len(key), bool)
                        for x in hits:
                            mine = bucket == x["bucket"]
                            got[mine] |= in_sorted(key[mine], np.unique(np.frombuffer(x["hits"], U)))
                        edge = np.zeros(b - a + 1, np.int64)
                        s = np.flatnonzero(got)
                        edge[s] += 1
                        edge[s + WINDOW] -= 1
                        removed = np.cumsum(edge)[:-1] > 0
                    text = b" ".join([raw[starts[i] : ends[i]] for i in range(a, b) if not removed[i - a]]) if removed.any() else b" ".join(raw[slab.off[d] : slab.off[d + 1]].split())
                    n_words.append(b - a)
                    n_removed.append(int(removed.sum()))
                    digests.append(hashlib.sha256(text).hexdigest())
                    if with_texts:
                        texts.append(text.decode("utf-8", "surrogatepass"))
            cols = [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), *([pa.array(texts, pa.string())] if with_texts else [])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if with_texts else [])])

    return run


def remove_repeats(docs: DataFrame, texts: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, and with `texts` the words kept as `kept`."""
    buckets = width(docs)
    bits = log2(buckets)
    rows = _documents(docs)
    sent = rows.select("id", "text").mapInArrow(_first_pass(bits), CELL)
    hits = cut(by_bucket(sent, buckets).mapInArrow(_match, _REPLY), free=True)
    near = rows.select("id", "text").join(_gathered(hits), "id").select("id", "text", "hits")
    around = near.mapInArrow(_third_pass(bits), CELL)
    repeats = cut(by_bucket(around, buckets).mapInArrow(_resolve, _REPLY), free=True)
    done = rows.join(_gathered(repeats), "id", "left").select("doc_id", "text", "hits")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept", T.StringType())] if texts else [])])
    return done.mapInArrow(_last_pass(bits, texts), schema)
