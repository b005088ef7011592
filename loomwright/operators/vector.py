"""Nearest neighbours: exact, by inverted lists (IVF) with optional quantisers, batched, and over multivectors.

Results are in the order of distance, then row id; null and non-finite distances never come back. A range keeps lower <= d < upper.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import distance as D
from ..sources.table import DISTANCE, POINTS, ROWID, TableError


def _check(df: DataFrame, column: str, q: Sequence[float], k: int) -> None:
    if k <= 0:
        raise TableError("k must be positive")
    if len(q) == 0:
        raise TableError("the query vector is empty")
    first = df.filter(F.col(column).isNotNull()).select(F.size(column)).first()
    if first is not None and first[0] != len(q):
        raise TableError(f"the query has {len(q)} dimensions, {column} has {first[0]}")


def _in_range(df: DataFrame, span: tuple[float | None, float | None] | None) -> DataFrame:
    df = df.filter(F.col(DISTANCE).isNotNull())
    if span is not None:
        low, high = span
        df = df if low is None else df.filter(F.col(DISTANCE) >= low)
        df = df if high is None else df.filter(F.col(DISTANCE) < high)
    return df


def flat(df: DataFrame, column: str, q: Sequence[float], k: int, metric: str = "l2", distance_range=None, tie: str = ROWID) -> DataFrame:
    """The k nearest rows by an exact scan: a codegen'd projection and a top-k per task, no shuffle of the table."""
    df = df.filter(D.finite(F.col(column))) if metric != "hamming" else df.filter(F.col(column).isNotNull())
    vector = F.array(*(F.lit(int(x)) for x in q)) if metric == "hamming" else D.literal(q)
    df = df.withColumn(DISTANCE, D.distance(metric, F.col(column), vector))
    return _in_range(df, distance_range).orderBy(DISTANCE, tie).limit(k)


def flat_multivector(df: DataFrame, column: str, queries: Sequence[Sequence[float]], k: int, metric: str = "cosine", tie: str = ROWID) -> DataFrame:
    """Late interaction over lists of vectors: 1 - sum of each query vector's best similarity."""
    df = df.filter(F.size(column) > 0).withColumn(DISTANCE, D.multivector(metric, F.col(column), queries))
    return _in_range(df, None).orderBy(DISTANCE, tie).limit(k)


def xtr(df: DataFrame, column: str, queries: Sequence[Sequence[float]], k: int, per_query: int, metric: str = "cosine", tie: str = ROWID) -> DataFrame:
    """Scores rows from one candidate list per query vector; a row missing from a list gets the list's least similarity. number of queries - sum."""
    flatted = df.select(tie, F.explode(column).alias("_v"))
    rows = None
    for i, q in enumerate(queries):
        near = flatted.withColumn("_sim", 1.0 - D.distance(metric, F.col("_v"), D.literal(q))).groupBy(tie).agg(F.max("_sim").alias("_sim"))
        near = near.orderBy(F.col("_sim").desc(), tie).limit(per_query).withColumn("_q", F.lit(i))
        rows = near if rows is None else rows.unionByName(near)
    least = rows.groupBy("_q").agg(F.min("_sim").alias("_least"))
    total = least.agg(F.sum("_least")).first()[0] or 0.0
    gain = rows.join(least, "_q").groupBy(tie).agg(F.sum(F.col("_sim") - F.col("_least")).alias("_gain"))
    return gain.select(tie, (F.lit(float(len(queries))) - (F.col("_gain") + total)).alias(DISTANCE)).orderBy(DISTANCE, tie).limit(k)


def _kernel(metric: str, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of all rows to all queries, (rows, queries)."""
    if metric == "l2":
        return np.maximum((rows * rows).sum(1)[:, None] - 2 * rows @ q.T + (q * q).sum(1)[None, :], 0)
    if metric == "dot":
        return 1 - rows @ q.T
    size = np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - rows @ q.T / size


#: Query vectors that one pass over the table answers; more go in more passes.
QUERY_BLOCK = 4096


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that are whole and finite: places and matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    ok = np.flatnonzero((sizes == width) & (width > 0))
    values = column.take(pa.array(ok)).flatten().cast(pa.float64()).fill_null(float("nan"))
    m = values.to_numpy(zero_copy_only=False).reshape(len(ok), width)
    good = np.isfinite(m).all(1)
    return ok[good], m[good]


class _Best:
    """The k nearest rows of every query so far, by distance and key."""

    def __init__(self, queries: int, k: int):
        self.d, self.key = np.full((queries, k), np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, of: np.ndarray, d: np.ndarray, keys: np.ndarray) -> None:
        """Distances (queries `of`, rows): only those that reach a query's k are merged."""
        k = self.d.shape[1]
        last = self.d[of, -1]
        if k < d.shape[1] and np.isinf(last).any():
            last = np.minimum(last, np.partition(d, k - 1, axis=1)[:, k - 1])
        row, col = np.nonzero((d <= last[:, None]) & np.isfinite(d))
        if not len(row):
            return
        met, row_of = np.unique(row, return_inverse=True)
        q = of[met]
        group = np.concatenate([np.repeat(np.arange(len(met)), k), row_of])
        far = np.concatenate([self.d[q].ravel(), d[row, col]])
        key = np.concatenate([self.key[q].ravel(), keys[col]])
        order = np.lexsort((key, far, group))
        size = np.bincount(group, minlength=len(met))
        order = order[(np.cumsum(size) - size)[:, None] + np.arange(k)]
        self.d[q], self.key[q] = far[order], key[order]

    def rows(self, name: str) -> pa.RecordBatch:
        q, at = np.nonzero(np.isfinite(self.d))
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(self.key[q, at]), pa.array(self.d[q, at])], ["q", "key", name])


def batch(df: DataFrame, column: str, queries: DataFrame, query_id: str, query_vector: str, k: int, metric: str = "l2", key: str = ROWID) -> DataFrame:
    """The k nearest rows of every query: (query_id, key, _distance, rank).

    The queries are fetched in blocks of QUERY_BLOCK; a block goes to every task, whose matrix product keeps k rows a query, so what is shuffled
    is k rows per query and task."""
    total = queries.count()
    parts = max(1, -(-2 * total // QUERY_BLOCK))
    out = None
    for part in range(parts):  # hash blocks: about half of QUERY_BLOCK each
        mine = queries.filter(F.pmod(F.xxhash64(query_id), F.lit(parts)) == part) if parts > 1 else queries
        block = mine.select(query_id, query_vector).orderBy(query_id).collect()
        if not block:
            continue
        q, names = np.array([r[1] for r in block], np.float64), [r[0] for r in block]

        def run(batches: Iterator[pa.RecordBatch], q=q, names=names) -> Iterator[pa.RecordBatch]:
            best = _Best(len(q), k)
            for b in batches:
                at, m = _matrix(b.column(1))
                keys = b.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)[at]
                for s in range(0, len(m), 1024):
                    best.add(np.arange(len(q)), _kernel(metric, m[s : s + 1024], q).T, keys[s : s + 1024])
            yield best.rows(DISTANCE)

        found = df.select(F.col(key).cast("long"), column).mapInArrow(run, f"q long, key long, {DISTANCE} double")
        ranked = found.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct(DISTANCE, "key"))), 1, k).alias("top")).select("q", F.posexplode("top").alias("rank", "hit"))
        name = df.sparkSession.createDataFrame(list(enumerate(names)), T.StructType([T.StructField("q", T.LongType()), T.StructField("_name", queries.schema[query_id].dataType)]))
        found = ranked.join(F.broadcast(name), "q").select(F.col("_name").alias(query_id), F.col("hit.key").alias(key), F.col(f"hit.{DISTANCE}").alias(DISTANCE), (F.col("rank") + 1).alias("rank"))
        out = found if out is None else out.unionByName(found)
    return out


# -- inverted lists ------------------------------------------------------------------------------------


def kmeans(points: np.ndarray, k: int, iterations: int = 50, tol: float = 1e-4, seed: int = 0) -> np.ndarray:
    """Lloyd's algorithm on a bounded sample; empty clusters restart at the farthest points."""
    r = np.random.default_rng(seed)
    k = min(k, len(points))
    centres = points[r.choice(len(points), k, replace=False)].copy()
    before = np.inf
    for _ in range(iterations):
        d = _kernel("l2", points, centres)
        to = d.argmin(1)
        loss = float(d[np.arange(len(points)), to].sum())
        counts = np.bincount(to, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, to, points)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        if (~full).any():
            centres[~full] = points[np.argsort(-d.min(1))[: int((~full).sum())]]
        if before - loss <= tol * max(before if np.isfinite(before) else 0, 1e-12):
            break
        before = loss
    return centres


#: Product codes of a vector, the second one of what the first leaves; sign codes of a vector, each of what those before leave; sampled vectors per codeword.
PQ_LEVELS, RQ_LEVELS, PER_WORD = 2, 4, 32


@dataclass
class IvfModel:
    """Centroids, and what the quantiser needs. kind: flat, pq, sq or rq."""

    metric: str
    centres: np.ndarray
    kind: str = "flat"
    codebooks: np.ndarray | None = None  # (PQ_LEVELS * m, 2**bits, d / m): those of a level encode what the one before leaves
    bounds: tuple[float, float] | None = None
    rotation: np.ndarray | None = None

    def place(self, m: np.ndarray) -> np.ndarray:
        return _kernel("l2", m, self.centres).argmin(1)

    def prepare(self, m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) if self.metric == "cosine" else m

    def encode(self, m: np.ndarray, part: np.ndarray) -> list[bytes]:
        """Codes of vectors in their partitions."""
        if self.kind == "pq":
            size = self.codebooks.shape[2]
            left = (m - self.centres[part]).reshape(len(m), -1, size)
            codes = np.zeros((len(m), len(self.codebooks)), np.uint8)
            for j, book in enumerate(self.codebooks):
                own = left[:, j % left.shape[1]]
                codes[:, j] = _kernel("l2", own, book).argmin(1)
                own -= book[codes[:, j]]
        elif self.kind == "sq":
            low, high = self.bounds
            codes = np.clip(np.round((m - low) / max(high - low, 1e-12) * 255), 0, 255).astype(np.uint8)
        elif self.kind == "rq":
            left = (m - self.centres[part]) @ self.rotation
            signs, scales = [], []
            for _ in range(RQ_LEVELS):
                scales.append(np.abs(left).mean(axis=1))
                signs.append(np.packbits(left > 0, axis=1))
                left = left - np.where(left > 0, 1.0, -1.0) * scales[-1][:, None]
            return [c.tobytes() + x.tobytes() for c, x in zip(np.concatenate(signs, axis=1), np.stack(scales, axis=1).astype(np.float32))]
        else:
            codes = m.astype(np.float32)
        return [c.tobytes() for c in codes]

    def to_json(self) -> dict:
        """Plain values: arrays as base64 of their bytes."""
        def plain(x):
            return {"shape": list(x.shape), "data": base64.b64encode(np.ascontiguousarray(x, np.float64).tobytes()).decode()} if isinstance(x, np.ndarray) else x

        return {f.name: plain(getattr(self, f.name)) for f in fields(self)}

    @staticmethod
    def from_json(body: dict) -> IvfModel:
        def array(x):
            return np.frombuffer(base64.b64decode(x["data"]), np.float64).reshape(x["shape"]) if isinstance(x, dict) else tuple(x) if isinstance(x, list) else x

        return IvfModel(**{k: array(v) for k, v in body.items()})

    def decode(self, codes: list[bytes], part: int) -> np.ndarray:
        """The vectors of one partition that the codes stand for."""
        n, d = len(codes), self.centres.shape[1]
        if self.kind == "flat":
            return np.frombuffer(b"".join(codes), np.float32).reshape(n, -1).astype(np.float64)
        raw = np.frombuffer(b"".join(codes), np.uint8).reshape(n, -1)
        if self.kind == "sq":
            low, high = self.bounds
            return raw / 255 * (high - low) + low
        if self.kind == "pq":
            m = d // self.codebooks.shape[2]
            words = self.codebooks[np.arange(len(self.codebooks))[None, :], raw]
            return words.reshape(n, -1, m, words.shape[2]).sum(1).reshape(n, d) + self.centres[part]
        levels = RQ_LEVELS
        scales = np.ascontiguousarray(raw[:, -4 * levels :]).view(np.float32).astype(np.float64)
        signs = np.unpackbits(raw[:, : -4 * levels].reshape(n, levels, -1), axis=2)[:, :, :d] * 2.0 - 1
        return np.einsum("nl,nld->nd", scales, signs) @ self.rotation.T + self.centres[part]

    def estimates(self, codes: list[bytes], part: int, q: np.ndarray) -> np.ndarray:
        """Distances of codes of one partition to queries: (codes, queries)."""
        return _kernel("dot" if self.metric == "dot" else "l2", self.decode(codes, part), q)

    def estimate(self, codes: list[bytes], part: int, q: np.ndarray) -> np.ndarray:
        """Distances of a query to codes of one partition."""
        return self.estimates(codes, part, q[None, :])[:, 0]


def train(df: DataFrame, column: str, partitions: int, metric: str = "l2", kind: str = "flat", sub_vectors: int | None = None, bits: int = 8, sample_per_partition: int = 256, seed: int = 0) -> IvfModel:
    """Fits centroids on a sample of at most 256 vectors per partition (a parameter), and codebooks on at most `PER_WORD` per codeword.

    sub_vectors: 16 if the dimensions divide into so many, else the most below."""
    if metric not in ("l2", "cosine", "dot"):
        raise TableError(f"no index for metric {metric!r}")
    want = max(partitions * sample_per_partition, 1)
    most = max(want, PER_WORD << bits) if kind == "pq" else want
    rows = df.filter(D.finite(F.col(column)))
    total = rows.count()
    part = rows if total <= most else rows.sample(min(1.0, 1.2 * most / total), seed)
    m = _matrix(part.select(column).limit(most).toArrow().column(0))[1]
    if len(m) == 0:
        raise TableError("no vectors to train on")
    model = IvfModel(metric, np.zeros((1, m.shape[1])), kind)
    m = model.prepare(m)
    few = m if len(m) <= want else m[np.random.default_rng(seed).permutation(len(m))[:want]]
    model.centres = kmeans(few, partitions, seed=seed)
    if kind == "pq":
        sub_vectors = sub_vectors or max(i for i in range(1, 17) if m.shape[1] % i == 0)
        if m.shape[1] % sub_vectors:
            raise TableError(f"{m.shape[1]} dimensions do not divide into {sub_vectors} sub-vectors")
        left = (m - model.centres[model.place(m)]).reshape(len(m), sub_vectors, -1)
        books = []
        for j in range(PQ_LEVELS * sub_vectors):
            own = left[:, j % sub_vectors]
            books.append(kmeans(own, 1 << bits, 25, seed=seed + j))
            own -= books[-1][_kernel("l2", own, books[-1]).argmin(1)]
        size = max(map(len, books))
        model.codebooks = np.stack([np.concatenate([b, np.repeat(b[-1:], size - len(b), 0)]) for b in books])
    elif kind == "sq":
        model.bounds = float(m.min()), float(m.max())
    elif kind == "rq":
        model.rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(m.shape[1], m.shape[1])))[0]
    elif kind != "flat":
        raise TableError(f"unknown quantiser {kind!r}")
    return model


def assign(df: DataFrame, column: str, model: IvfModel, key: str = ROWID) -> DataFrame:
    """(key, part_id, code) of every row with a usable vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, m = _matrix(b.column(1))
            if len(at) == 0:
                continue
            m = model.prepare(m)
            part = model.place(m)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(part.astype(np.int32)), pa.array(model.encode(m, part), pa.binary())], [key, "part_id", "code"])

    return df.select(F.col(key).cast("long").alias(key), column).mapInArrow(run, f"{key} long, part_id int, code binary")


def probes(model: IvfModel, q: Sequence[float], nprobes: int, k: int, maximum: int | None = None) -> list[int]:
    """The partitions to search, nearest first. Partitions far beyond the nearest are left out once the least number is met."""
    point = model.prepare(np.array(q, np.float64)[None, :])
    d = _kernel("l2", point, model.centres)[0]
    order = np.argsort(d, kind="stable")
    factor = 0.6 if k <= 1 else 7.0 if k <= 10 else 81.0
    most = len(order) if maximum is None else maximum
    return [int(p) for i, p in enumerate(order[:most]) if i < nprobes or (maximum is not None and d[p] <= factor * d[order[0]])]


#: Rows beyond k that a list of whole vectors gives, whose distances are single precision.
SPARE = 32


def near_ids(lists: DataFrame, model: IvfModel, q: Sequence[float], n: int, parts: Sequence[int], mask: DataFrame | None = None, key: str = ROWID) -> DataFrame:
    """The n row ids of the probed partitions whose codes are nearest. mask: the row ids that may be found at all."""
    near = lists.filter(F.col("part_id").isin(list(parts)))
    if mask is not None:
        near = near.join(mask.select(key), key, "left_semi")
    point = model.prepare(np.array(q, np.float64)[None, :])[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(1).to_numpy(zero_copy_only=False)
            out = np.zeros(b.num_rows)
            codes = b.column(2).to_pylist()
            for p in np.unique(ids):
                at = np.flatnonzero(ids == p)
                out[at] = model.estimate([codes[i] for i in at], int(p), point)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], [key, "_estimate"])

    return near.select(key, "part_id", "code").mapInArrow(run, f"{key} long, _estimate double").orderBy("_estimate", key).limit(n).select(key)


def search(df: DataFrame, lists: DataFrame, model: IvfModel, column: str, q: Sequence[float], k: int, nprobes: int = 20, maximum_nprobes: int | None = None, refine: int | None = None, distance_range=None, key: str = ROWID, masked: bool = False, fetch=None) -> DataFrame:
    """The k nearest among the probed partitions: the best k * refine by code are measured again on their vectors.

    masked: `df` holds the rows that a filter allows, and they alone are ranked; partitions are added until k of them are there.
    fetch: gives the rows of up to POINTS row ids without reading the table."""
    want = k * max(1, refine or 1) + (SPARE if model.kind == "flat" else 0)
    parts = probes(model, q, nprobes, k, maximum_nprobes)
    mask = df if masked else None
    if masked and len(parts) < len(model.centres):
        # the late stage: a selective filter may leave fewer than k rows in the nearest partitions
        sizes = dict(lists.join(df.select(key), key, "left_semi").groupBy("part_id").count().collect())  # a row per partition
        order = probes(model, q, len(model.centres), k)
        n = len(parts)
        while n < len(order) and sum(sizes.get(p, 0) for p in order[:n]) < k:
            n += 1
        parts = order[:n]
    near = near_ids(lists, model, q, want, parts, mask, key)
    if fetch is not None and want <= POINTS:
        ids = [r[0] for r in near.collect()]  # k * refine ids
        rows = fetch(ids)
        rows = rows.join(df.select(key), key, "left_semi") if masked else rows
    else:
        rows = df.join(near, key, "left_semi")
    return flat(rows, column, q, k, model.metric, distance_range, key)


def nearest(df: DataFrame, column: str, q: Sequence[float], k: int = 10, metric: str | None = None, nprobes: int = 20, minimum_nprobes: int | None = None, maximum_nprobes: int | None = None, refine: int | None = None, use_index: bool = True, distance_range=None, table=None, fast_search: bool = False, masked: bool = False) -> DataFrame:
    """What `Scanner` asks for: by index where there is one, with rows the index doesn't cover searched exactly and merged. masked: a filter came before."""
    if q and isinstance(q[0], (list, tuple)):
        return flat_multivector(df, column, q, k, metric or "cosine")
    _check(df, column, q, k)
    entry = None
    if use_index and table is not None:
        from . import indices

        entry = indices.find(table, column, "vector")
    if entry is None:
        return flat(df, column, q, k, metric or "l2", distance_range)
    from . import indices

    model, lists = indices.load_vector(table, entry)
    if metric not in (None, model.metric):
        return flat(df, column, q, k, metric, distance_range)
    fresh = indices.uncovered(table, entry)
    covered = F.shiftright(ROWID, 32).isin(entry["fragments"]) if fresh else F.lit(True)
    plain = not masked and set(df.columns) == set(table.scan().columns)
    found = search(df.filter(covered), lists, model, column, q, k, minimum_nprobes or nprobes, maximum_nprobes, refine, distance_range, masked=masked, fetch=table.rows_of if plain or masked else None)
    if fast_search or not fresh:
        return found
    rest = flat(df.filter(~covered), column, q, k, model.metric, distance_range)
    return found.unionByName(rest.select(found.columns)).orderBy(DISTANCE, ROWID).limit(k)


def search_batch(df: DataFrame, lists: DataFrame, model: IvfModel, column: str, queries: DataFrame, query_id: str, query_vector: str, k: int, nprobes: int = 20, refine: int = 1, key: str = ROWID) -> DataFrame:
    """The k nearest rows of every query by index: (query_id, key, _distance, rank).

    Blocks of queries go to every task; a task ranks the codes of the partitions that a query probes, and what is shuffled is k * refine rows a query and
    task. The best k * refine of a query are measured again on their vectors."""
    want = k * max(1, refine) + (SPARE if model.kind == "flat" else 0)
    parts = max(1, -(-2 * queries.count() // QUERY_BLOCK))
    out = None
    for part in range(parts):
        mine = queries.filter(F.pmod(F.xxhash64(query_id), F.lit(parts)) == part) if parts > 1 else queries
        block = mine.select(query_id, query_vector).orderBy(query_id).collect()
        if not block:
            continue
        q = model.prepare(np.array([r[1] for r in block], np.float64))
        near = np.argsort(_kernel("l2", q, model.centres), axis=1, kind="stable")[:, :nprobes]
        asks = {int(p): np.flatnonzero((near == p).any(axis=1)) for p in np.unique(near)}

        def run(batches: Iterator[pa.RecordBatch], q=q, asks=asks) -> Iterator[pa.RecordBatch]:
            best = _Best(len(q), want)
            for b in batches:
                ids, keys, codes = b.column(1).to_numpy(zero_copy_only=False), b.column(0).to_numpy(zero_copy_only=False), b.column(2)
                for p in np.unique(ids):
                    at = np.flatnonzero(ids == p)
                    of = asks.get(int(p))
                    if of is None:
                        continue
                    for s in range(0, len(at), 1024):
                        mine = at[s : s + 1024]
                        best.add(of, model.estimates(codes.take(pa.array(mine)).to_pylist(), int(p), q[of]).T, keys[mine])
            yield best.rows("estimate")

        found = lists.filter(F.col("part_id").isin(list(asks))).select(key, "part_id", "code").mapInArrow(run, "q long, key long, estimate double")
        top = found.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("estimate", "key"))), 1, want).alias("top")).select("q", F.explode("top.key").alias(key))
        schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("_name", queries.schema[query_id].dataType), T.StructField("_vector", T.ArrayType(T.DoubleType()))])
        names = df.sparkSession.createDataFrame([(i, r[0], [float(x) for x in r[1]]) for i, r in enumerate(block)], schema)
        exact = df.select(key, column).join(top, key).join(F.broadcast(names), "q").withColumn(DISTANCE, D.distance(model.metric, F.col(column), F.col("_vector")))
        ranked = exact.groupBy("_name").agg(F.slice(F.sort_array(F.collect_list(F.struct(DISTANCE, key))), 1, k).alias("top")).select("_name", F.posexplode("top").alias("rank", "hit"))
        ranked = ranked.select(F.col("_name").alias(query_id), F.col(f"hit.{key}").alias(key), F.col(f"hit.{DISTANCE}").alias(DISTANCE), (F.col("rank") + 1).alias("rank"))
        out = ranked if out is None else out.unionByName(ranked)
    return out


def recall(found: Sequence[int], truth: Sequence[int]) -> float:
    return len(set(found) & set(truth)) / len(truth) if truth else 1.0
