"""Operator 2: suffix-array dedup by prefix-free parsing, for bytes that a 200-byte string covers which also starts elsewhere.

Rolling-hash triggers cut every text into phrases (`phrases.py`). The parse is then the list of a
document's phrases, and the dictionary is the set of distinct ones. Equal strings lie at the same place
of phrases that share the bytes right of their trigger, so
1. the parse goes to buckets by the hash of those bytes: a phrase that occurs twice repeats whole, one
   whose right side nobody shares repeats nowhere, and the rest is the contested dictionary;
2. contested phrases, one of each, are laid end to end and ordered by a suffix array; suffixes that agree
   to 200 bytes form classes. Batches of the dictionary are ordered by themselves, and their classes meet
   by a fingerprint of one member, so no task orders more than a batch and no group has to be in one;
3. starts that repeat, by phrase or by class, cover their bytes.
Phrases overlap by 199 bytes, so 200 bytes never need the order of what follows a phrase: of the parse,
multiplicities are enough.

Repeats inside one batch of documents are merged before they are sent. Fingerprints are 64 bits plus
those of the bucket. Defined results: null is an empty text; texts under 200 bytes lose nothing;
repeated rows remove each other; an empty table gives an empty result; only doc_id and text are read, so other
columns may bear any name; an id that is no integer is a TypeError before anything runs.
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
from .exchange import CELL, GATHER, batch_of, bucket_stream, by_bucket, cells, ids_of, in_sorted, log2, long_id, runs, width
from .phrases import SIZE, Parse, bucket_key, bucket_sums, string_key, suffix_ranks
from .textvec import U, slabs

_REPLY = "id long, state int, hits binary"
_REPLY_ARROW = pa.schema([("id", pa.int64()), ("state", pa.int32()), ("hits", pa.binary())])
#: States of a replied hash: the phrase repeats; it repeats and is to be sent; it is to be sent; the string repeats.
REPEATS, REPEATS_SEND, SEND, STRING = range(4)
#: Bytes of contested phrases that are ordered at a time.
DICTIONARY = 2_000_000
_PAIR = np.dtype([("whole", "<u8"), ("right", "<u4")])


def _replies(ids: np.ndarray, states: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(ids) == 0:
        return
    order = np.lexsort((states, ids))
    ids, states, hashes = ids[order], states[order], hashes[order]
    starts = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (states[1:] != states[:-1]))))
    ends = np.append(starts[1:], len(ids))
    for i in range(0, len(starts), 5000):
        s, e = starts[i : i + 5000], ends[i : i + 5000]
        yield pa.RecordBatch.from_arrays([pa.array(ids[s]), pa.array(states[s].astype(np.int32)), pa.array([hashes[a:b].tobytes() for a, b in zip(s, e)], pa.binary())], schema=_REPLY_ARROW)


def _parse_pass(bits: int):
    """The parse: phrases met once in the batch (kind 0), one of each met more often (kind 1), and all of the latter (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            right, whole, ids = (np.concatenate([p[i] for p in parts]) for i in range(3))
            parts.clear()
            held = 0
            order = np.argsort(whole, kind="stable")
            first, n = runs(whole[order])
            one = np.sort(order[first[n == 1]])
            rep = np.sort(order[first[n > 1]])
            every = np.sort(order[np.repeat(n > 1, n)])
            bucket = (right >> U(64 - bits)).astype(np.int32)
            pair = np.empty(len(whole), _PAIR)
            pair["whole"], pair["right"] = whole, ((right >> U(32 - bits)) & U(0xFFFFFFFF)).astype(np.uint32)
            # ids of a batch come in runs, one per document
            doc = np.cumsum(np.concatenate(([0], ids[1:] != ids[:-1])))
            own = ids[runs(doc)[0]]
            out = [x for kind, pick in ((0, one), (1, rep), (2, every)) for x in cells(bucket[pick], doc[pick], own, pair[pick], kind)]
            for i in range(0, len(out), 32):
                yield batch_of(out[i : i + 32])

        for batch in batches:
            ids = ids_of(batch.column(0))
            for slab in slabs(batch.column(1)):
                p = Parse(slab)
                if len(p.start):
                    right, whole = p.hashes()
                    parts.append((right, whole, ids[slab.first + p.doc]))
                    held += len(whole)
                if held >= GATHER // 2:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket of right sides: which phrases repeat, and which are contested."""
    at, parts = None, []

    def close() -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        pair, ids, many = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((pair["whole"], pair["right"]))
        pair, ids, many = pair[order], ids[order], many[order]
        whole, right = pair["whole"], pair["right"]
        new_right = np.concatenate(([True], right[1:] != right[:-1]))
        new = new_right | np.concatenate(([True], whole[1:] != whole[:-1]))
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(whole)))
        repeats = np.repeat((n > 1) | np.maximum.reduceat(many, first), n)
        group = np.cumsum(new_right) - 1
        distinct = np.bincount(group, weights=new)[group]
        send = new & (distinct > 1)
        keep = repeats | send
        state = np.where(repeats, np.where(send, REPEATS_SEND, REPEATS), SEND)
        yield from _replies(ids[keep], state[keep], whole[keep])

    for bucket, kind, ids, counts, data in bucket_stream(batches):
        if bucket != at:
            yield from close()
            at, parts = bucket, []
        pair, each = np.frombuffer(data, _PAIR), np.repeat(ids, counts)
        if kind == 2:
            yield from _replies(each, np.full(len(each), REPEATS), pair["whole"])
        else:
            parts.append((pair, each, np.full(len(each), kind == 1)))
    yield from close()


def _hits(cell, *states: int) -> np.ndarray:
    """The sorted hashes of one document's replies that have one of the states."""
    found = [np.frombuffer(x["hits"], U) for x in cell or () if x["state"] in states]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, U)


def _phrases(p: Parse, d: int) -> slice:
    """The phrases of document d of the slab."""
    return slice(int(np.searchsorted(p.doc, d)), int(np.searchsorted(p.doc, d, "right")))


def _order_pass(bits: int):
    """Suffix arrays over batches of the contested dictionary: a member of each class, known to repeat (kind 1) or not (kind 0), and the starts of classes that repeat here (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text: list[np.ndarray] = []
        rows: list[tuple[np.ndarray, ...]] = []  # place in text, key, bucket key, id, repeats
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            place, key, other, ids, known = (np.concatenate([r[i] for r in rows]) for i in range(5))
            rank = suffix_ranks(np.concatenate(text), place).astype(np.int64)
            text.clear()
            rows.clear()
            size = 0
            count = np.bincount(rank)
            sure = np.bincount(rank, weights=known) > 0
            repeated = (count > 1) | sure
            rep = np.unique(rank, return_index=True)[1]
            bucket = (other >> U(64 - bits)).astype(np.int32)
            doc = np.cumsum(np.concatenate(([0], ids[1:] != ids[:-1])))
            own = ids[runs(doc)[0]]
            rep.sort()
            here = np.flatnonzero(repeated[rank] & ~known)
            lone, more = rep[~repeated[rank[rep]]], rep[repeated[rank[rep]]]
            out = [x for kind, pick in ((0, lone), (1, more), (2, here)) for x in cells(bucket[pick], doc[pick], own, key[pick], kind)]
            for i in range(0, len(out), 32):
                yield batch_of(out[i : i + 32])

        for batch in batches:
            ids, replies = ids_of(batch.column(0)), batch.column(2)
            for slab in slabs(batch.column(1)):
                p = Parse(slab)
                if not len(p.start):
                    continue
                whole, sums = p.hashes()[1], bucket_sums(slab)
                for d in range(len(slab)):
                    mine, cell = _phrases(p, d), replies[slab.first + d].as_py()
                    send = _hits(cell, SEND, REPEATS_SEND)
                    pick = np.flatnonzero(in_sorted(whole[mine], send)) + mine.start
                    # a phrase stands once in the dictionary
                    pick = pick[np.unique(whole[pick], return_index=True)[1]]
                    if not len(pick):
                        continue
                    known = in_sorted(whole[pick], _hits(cell, REPEATS, REPEATS_SEND))
                    a, b = p.start[pick], p.stop[pick]
                    n = b - a
                    at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
                    key, other = string_key(at, p.sums), bucket_key(at, sums)
                    long = n + SIZE - 1
                    before = size + np.cumsum(long) - long
                    text.extend(slab.data[i : j + SIZE - 1] for i, j in zip(a, b))
                    rows.append((np.repeat(before - a, n) + at, key, other, np.full(len(at), ids[slab.first + d]), np.repeat(known, n)))
                    size += int(long.sum())
                    if size >= DICTIONARY:
                        yield from flush()
        if rows:
            yield from flush()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes of all batches, by the fingerprint of their members: strings that repeat."""
    at, parts = None, []

    def close() -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        key, ids, many = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.argsort(key, kind="stable")
        first, n = runs(key[order])
        repeats = np.repeat((n > 1) | np.maximum.reduceat(many[order], first), n)
        pick = order[repeats & ~many[order]]
        yield from _replies(ids[pick], np.full(len(pick), STRING), key[pick])

    for bucket, kind, ids, counts, data in bucket_stream(batches):
        if bucket != at:
            yield from close()
            at, parts = bucket, []
        key, each = np.frombuffer(data, U), np.repeat(ids, counts)
        if kind == 2:
            yield from _replies(each, np.full(len(each), STRING), key)
        else:
            parts.append((key, each, np.full(len(each), kind == 1)))
    yield from close()


def _cover(with_texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies = batch.column(2)
            sizes, removed, spans, digests, texts = [], [], [], [], []
            for slab in slabs(batch.column(1)):
                p = whole = None
                for d in range(len(slab)):
                    a, b = int(slab.off[d]), int(slab.off[d + 1])
                    gone = np.zeros(b - a, bool)
                    cell = replies[slab.first + d]
                    if cell.is_valid and b - a >= SIZE:
                        if p is None:
                            p = Parse(slab)
                            whole = p.hashes()[1]
                        mine, cell = _phrases(p, d), cell.as_py()
                        edge = np.zeros(b - a + 1, np.int64)
                        hit = np.flatnonzero(in_sorted(whole[mine], _hits(cell, REPEATS, REPEATS_SEND))) + mine.start
                        edge[p.start[hit] - a] += 1
                        np.subtract.at(edge, p.stop[hit] - 1 + SIZE - a, 1)
                        strings = _hits(cell, STRING)
                        if len(strings):
                            at = np.arange(a, b - SIZE + 1)
                            key = string_key(at, p.sums)
                            found = np.flatnonzero(in_sorted(key, strings))
                            edge[found] += 1
                            edge[found + SIZE] -= 1
                        gone = np.cumsum(edge)[:-1] > 0
                    text = slab.data[a:b][~gone].tobytes()
                    sizes.append(b - a)
                    removed.append(int(gone.sum()))
                    spans.append(int(np.count_nonzero(np.diff(np.concatenate(([False], gone)).astype(np.int8)) == 1)))
                    digests.append(hashlib.sha256(text).hexdigest())
                    if with_texts:
                        texts.append(text)
            cols = [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(digests, pa.string()), *([pa.array(texts, pa.binary())] if with_texts else [])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_texts else [])])

    return run


def remove_repeated_bytes(docs: DataFrame, texts: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with `texts` the bytes kept as `kept`."""
    buckets = width(docs)
    bits = log2(buckets)
    rows = docs.select("doc_id", "text", long_id(docs).alias("id"))
    parse = rows.select("id", "text").mapInArrow(_parse_pass(bits), CELL)
    phrases = cut(by_bucket(parse, buckets).mapInArrow(_count, _REPLY), free=True)
    reply = F.collect_list(F.struct("state", "hits")).alias("hits")
    contested = phrases.groupBy("id").agg(reply).filter(F.exists("hits", lambda x: x["state"] != REPEATS))
    classes = rows.select("id", "text").join(contested, "id").select("id", "text", "hits").mapInArrow(_order_pass(bits), CELL)
    strings = cut(by_bucket(classes, buckets).mapInArrow(_merge, _REPLY), free=True)
    found = phrases.filter(F.col("state") != SEND).union(strings).groupBy("id").agg(reply)
    done = rows.join(found, "id", "left").select("doc_id", "text", "hits")
    long = T.LongType()
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, long) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept", T.BinaryType())] if texts else [])])
    return done.mapInArrow(_cover(texts), schema)
