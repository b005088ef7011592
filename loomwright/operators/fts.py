"""Full-text search: tokens, postings and BM25 as DataFrame plans.

score = sum over query terms of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average)), with k1 1.2, b 0.75 and
idf ln((N - n + 0.5) / (n + 0.5) + 1); N, n and lengths are those of all live rows of the source. A repeated query term
counts once. AND asks for every term. Results: the rows with `_score`, best first, then by row id.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import slabs, split_tokens, tokens
from ..sources.store import scratch
from ..sources.table import ROWID, SCORE, TableError

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Analyzer:
    """How texts become tokens."""

    base: str = "simple"
    lower: bool = True
    max_length: int | None = 40
    fold: bool = False
    stop_words: tuple[str, ...] = ()
    stem: bool = False
    ngram: tuple[int, int] = (3, 3)
    prefix_only: bool = False

    def of(self, column):
        out = tokens(column, self.lower, self.max_length, self.fold, self.stop_words, self.base, self.ngram, self.prefix_only)
        if self.stem:
            from ..functions.stem import stem_all

            out = stem_all(out)
        return out

    @property
    def plain(self) -> bool:
        """Whether `split_tokens` does what `of` does."""
        return self.base == "simple" and not (self.fold or self.stop_words or self.stem)

    def column(self, column):
        """What the passes over texts take: texts, or lists of tokens where these need `of`."""
        return column if self.plain else self.of(column)


@dataclass(frozen=True)
class Match:
    text: str
    column: str | None = None
    operator: str = "or"
    boost: float = 1.0
    fuzziness: int | str | None = 0
    max_expansions: int = 50
    prefix_length: int = 0


@dataclass(frozen=True)
class Phrase:
    text: str
    column: str | None = None
    slop: int = 0


@dataclass(frozen=True)
class Boost:
    positive: object
    negative: object
    negative_boost: float = 0.5


@dataclass(frozen=True)
class MultiMatch:
    text: str
    columns: Sequence[str]
    boosts: Sequence[float] | None = None
    operator: str = "or"


@dataclass(frozen=True)
class Boolean:
    must: Sequence = field(default=())
    should: Sequence = field(default=())
    must_not: Sequence = field(default=())


def parse(text: str) -> object:
    """A query from its JSON form: match, match_phrase, boost, multi_match or boolean."""
    return _parse(json.loads(text))


def _parse(body: dict) -> object:
    (kind, v), *more = body.items()
    if more:
        raise TableError("a query has one kind")
    if kind == "match":
        return Match(v["terms"], v.get("column"), v.get("operator", "or").lower(), v.get("boost", 1.0), v.get("fuzziness", 0), v.get("max_expansions", 50), v.get("prefix_length", 0))
    if kind in ("match_phrase", "phrase"):
        return Phrase(v["terms"], v.get("column"), v.get("slop", 0))
    if kind == "boost":
        return Boost(_parse(v["positive"]), _parse(v["negative"]), v.get("negative_boost", 0.5))
    if kind == "multi_match":
        text = v.get("query", v.get("terms"))
        return MultiMatch(text, v["columns"], v.get("boost"), v.get("operator", "or").lower())
    if kind == "boolean":
        return Boolean(*([_parse(x) for x in v.get(k, [])] for k in ("must", "should", "must_not")))
    raise TableError(f"unknown query {kind!r}")


def _text(df: DataFrame, column: str):
    kind = df.schema[column].dataType.simpleString()
    return F.concat_ws("\n", column) if kind == "array<string>" else F.col(column)


def _passes(analyzer: Analyzer, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Keys, and `split_tokens` of their texts, some megabytes at a time."""
    for batch in batches:
        for row, part in slabs(batch.column(1)):
            yield batch.column(0).slice(row, len(part)), *split_tokens(part, analyzer.lower, analyzer.max_length)


def _grouped(keys: pa.Array, row: np.ndarray, pos: np.ndarray, length: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Of tokens with codes: the codes of the different (code, row), ascending, and their key, length, tf and positions."""
    order = np.argsort(code, kind="stable")  # tokens come by row and place
    code, row, pos = code[order], row[order], pos[order]
    starts = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])))) if len(code) else np.zeros(0, np.int64)
    tf = np.diff(np.append(starts, len(code)))
    positions = pa.ListArray.from_arrays(pa.array(np.append(starts, len(code)), pa.int32()), pa.array(pos, pa.int32()))
    return code[starts], [keys.take(pa.array(row[starts])), pa.array(length[row[starts]], pa.int32()), pa.array(tf, pa.int32()), positions]


_HIT = ("length", "tf", "positions")


def postings(df: DataFrame, column: str, key: str = ROWID, analyzer: Analyzer = Analyzer()) -> DataFrame:
    """The inverted index of a text (or list of texts) column: (term, hits) with hits of (key, length, tf, positions); a term has a row for each few megabytes of text that hold it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, values, row, pos, length in _passes(analyzer, batches):
            words = pc.dictionary_encode(values)
            code, hits = _grouped(keys, row, pos, length, words.indices.to_numpy(zero_copy_only=False))
            edges = np.searchsorted(code, np.arange(len(words.dictionary) + 1))
            packed = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(hits, [key, *_HIT]))
            yield pa.RecordBatch.from_arrays([words.dictionary, packed], ["term", "hits"])

    hit = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("length", T.IntegerType()), T.StructField("tf", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("hits", T.ArrayType(hit))])
    rows = df.filter(F.col(column).isNotNull()).select(key, analyzer.column(_text(df, column)).alias("_t"))
    return rows.mapInArrow(run, schema)


def unpacked(packed: DataFrame, key: str = ROWID) -> DataFrame:
    """(term, key, length, tf, positions) of an inverted index."""
    return packed.select("term", F.explode("hits").alias("_h")).select("term", *(f"_h.{c}" for c in (key, *_HIT)))


class Index:
    """Term statistics and hits of one column of a frame. All terms of a query are named by `want` first; one pass over the texts then finds them."""

    def __init__(self, df: DataFrame, column: str, key: str = ROWID, analyzer: Analyzer = Analyzer(), stored: DataFrame | None = None):
        self.df, self.column, self.key, self.analyzer = df, column, key, analyzer
        self.stored = stored
        self.rows = df.filter(F.col(column).isNotNull()).select(key, analyzer.column(_text(df, column)).alias("_t"))
        self.wanted: set[str] = set()
        self._groups: dict[Match, dict[str, list[str]]] = {}
        self._found: tuple[DataFrame, int, float] | None = None

    def want(self, q: Match | Phrase) -> None:
        if isinstance(q, Phrase):
            self.wanted |= set(self.terms(q.text))
        elif q not in self._groups:
            self._groups[q] = {t: self.expand(t, q.fuzziness, q.max_expansions, q.prefix_length) for t in dict.fromkeys(self.terms(q.text))}
            self.wanted |= {x for g in self._groups[q].values() for x in g}

    def groups(self, q: Match) -> dict[str, list[str]]:
        """The query's terms, each with those of the dictionary that stand for it."""
        self.want(q)
        return self._groups[q]

    def _pass(self) -> tuple[DataFrame, int, float]:
        """Hits of the wanted terms, rows with a text, and their average length."""
        if self._found is None and self.stored is not None:
            n, total = self.rows.count(), self.stored.agg(F.sum("tf")).first()[0]
            self._found = self.stored.filter(F.col("term").isin(sorted(self.wanted))), n, (total or 0) / n if n else 0.0
        elif self._found is None:
            wanted, analyzer, key = pa.array(sorted(self.wanted), pa.string()), self.analyzer, self.key
            kind = self.df.schema[key].dataType

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                names = [key, *_HIT, "term", "docs", "tokens"]
                for keys, values, row, pos, length in _passes(analyzer, batches):
                    code = pc.fill_null(pc.index_in(values, value_set=wanted), -1).to_numpy(zero_copy_only=False)
                    at = np.flatnonzero(code >= 0)
                    of, hits = _grouped(keys, row[at], pos[at], length, code[at])
                    none = pa.nulls(len(of), pa.int64())
                    yield pa.RecordBatch.from_arrays([*hits, wanted.take(pa.array(of)), none, none], names)
                    sums = [pa.array([len(keys)]), pa.array([int(length.sum())])]
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, c.type) for c in hits), pa.nulls(1, pa.string()), *sums], names)

            fields = [T.StructField(key, kind), T.StructField("length", T.IntegerType()), T.StructField("tf", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("term", T.StringType()), T.StructField("docs", T.LongType()), T.StructField("tokens", T.LongType())]
            folder = scratch(self.df.sparkSession)
            self.rows.mapInArrow(run, T.StructType(fields)).write.parquet(folder)  # the hits are few: the texts are read once, whatever the query does with them
            found = self.df.sparkSession.read.schema(T.StructType(fields)).parquet(folder)
            n, total = found.agg(F.sum("docs"), F.sum("tokens")).first()
            hits = found.filter(F.col("docs").isNull()).drop("docs", "tokens")
            if key != ROWID:  # any other key may stand twice
                hits = hits.groupBy(key, "term").agg(F.first("length").alias("length"), F.sum("tf").alias("tf"), F.flatten(F.collect_list("positions")).alias("positions"))
            self._found = hits, n or 0, (total or 0) / n if n else 0.0
        return self._found

    def stats(self) -> tuple[int, float]:
        """Rows with a text, and their average length."""
        return self._pass()[1:]

    def terms(self, text: str) -> list[str]:
        if self.analyzer.plain:
            return split_tokens(pa.array([text]), self.analyzer.lower, self.analyzer.max_length)[0].to_pylist()
        row = self.df.sparkSession.range(1).select(self.analyzer.of(F.lit(text)).alias("t")).first()
        return list(row["t"])

    def hits(self, terms: Sequence[str]) -> DataFrame:
        """(key, length, term, tf, positions) of the rows that hold a term."""
        return self._pass()[0].filter(F.col("term").isin(list(terms)))

    def score(self, hits: DataFrame) -> DataFrame:
        """(key, term, weight) by BM25."""
        n, average = self.stats()
        idf = F.log((F.lit(float(n)) - F.col("_df") + 0.5) / (F.col("_df") + 0.5) + 1.0)
        tf = F.col("tf").cast("double")
        weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / (average or 1.0)))
        counts = hits.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
        # a row per query term: broadcast is bounded by the query
        return hits.join(F.broadcast(counts), "term").select(self.key, "term", weight.alias("weight"))

    def expand(self, term: str, fuzziness: int | str | None, limit: int, prefix: int) -> list[str]:
        """The terms of the dictionary within an edit distance."""
        n = (0 if len(term) <= 2 else 1 if len(term) <= 5 else 2) if fuzziness == "auto" else int(fuzziness or 0)
        if n == 0:
            return [term]
        if self.stored is not None:
            words = self.stored.select("term").distinct()
        else:
            analyzer = self.analyzer

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for _, values, *_ in _passes(analyzer, batches):
                    values = pc.unique(values)
                    size = pc.utf8_length(values).to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([values.filter(pa.array(np.abs(size - len(term)) <= n))], ["term"])

            words = self.rows.mapInArrow(run, "term string").distinct()
        near = F.levenshtein(F.col("term"), F.lit(term), n)
        words = words.filter(near.between(0, n))
        if prefix:
            words = words.filter(F.substring("term", 1, prefix) == term[:prefix])
        return [r["term"] for r in words.orderBy(near, "term").limit(limit).collect()]


def _match(index: Index, q: Match) -> DataFrame:
    groups = index.groups(q)
    every = sorted({x for g in groups.values() for x in g})
    if not every:
        return index.df.select(index.key, F.lit(0.0).alias(SCORE)).limit(0)
    scored = index.score(index.hits(every))
    total = F.sum("weight") * q.boost
    out = scored.groupBy(index.key).agg(total.alias(SCORE), F.collect_set("term").alias("_terms"))
    if q.operator == "and":
        for g in groups.values():
            out = out.filter(F.arrays_overlap("_terms", F.array(*(F.lit(x) for x in g)))) if g else out.limit(0)
    return out.select(index.key, SCORE)


def _phrase(index: Index, q: Phrase) -> DataFrame:
    """Rows in which the words stand one behind the other, each at most `slop` places late."""
    terms = index.terms(q.text)
    if not terms:
        return index.df.select(index.key, F.lit(0.0).alias(SCORE)).limit(0)
    key = index.key
    hits = index.hits(sorted(set(terms)))
    # per row, the sorted places where the phrase would start if this word stood in its place; the walk keeps those at which the words so far can end
    places = [F.flatten(F.collect_list(F.when(F.col("term") == t, F.col("positions")))) for t in terms]
    lists = hits.groupBy(key).agg(*(p.alias(f"_p{i}") for i, p in enumerate(places)))
    lists = lists.select(key, *(F.sort_array(F.expr(f"transform(_p{i}, x -> x - {i})")).alias(f"_at{i}") for i in range(len(terms))))
    ends = F.col("_at0")
    for i in range(1, len(terms)):
        mine = F.col(f"_at{i}")
        if q.slop == 0:
            ends = F.array_intersect(ends, mine)
        else:
            ends = F.array_intersect(mine, F.array_distinct(F.flatten(F.transform(ends, lambda p: F.sequence(p, p + q.slop)))))
    # document frequencies are those of the words, not of the phrase
    scored = index.score(hits).groupBy(key).agg(F.sum("weight").alias(SCORE))
    return scored.join(lists.withColumn("_ends", ends).filter(F.size("_ends") > 0).select(key), key, "left_semi")


def _leaves(query, columns: Sequence[str]) -> Iterator[tuple[str, Match | Phrase]]:
    """The columns that a query searches, each with what it looks for there."""
    if isinstance(query, (Match, Phrase)):
        yield from ((c, query) for c in ([query.column] if query.column else columns))
    elif isinstance(query, MultiMatch):
        yield from _matches(query)
    elif isinstance(query, Boost):
        for q in (query.positive, query.negative):
            yield from _leaves(q, columns)
    elif isinstance(query, Boolean):
        for q in (*query.must, *query.should, *query.must_not):
            yield from _leaves(q, columns)


def _matches(query: MultiMatch) -> list[tuple[str, Match]]:
    boosts = query.boosts or [1.0] * len(query.columns)
    return [(c, Match(query.text, c, query.operator, b)) for c, b in zip(query.columns, boosts)]


def scores(df: DataFrame, query, columns: Sequence[str], key: str = ROWID, analyzer: Analyzer = Analyzer(), stored: dict[str, DataFrame] | None = None) -> DataFrame:
    """(key, _score) of the rows a query finds."""
    if isinstance(query, str):
        query = parse(query) if query.lstrip().startswith("{") else Match(query)
    found: dict[str, Index] = {}
    for c, q in _leaves(query, columns):
        found.setdefault(c, Index(df, c, key, analyzer, (stored or {}).get(c))).want(q)
    return _scores(found, query, columns, key)


def _scores(found: dict[str, Index], query, columns: Sequence[str], key: str) -> DataFrame:
    again = lambda q: _scores(found, q, columns, key)
    if isinstance(query, (Match, Phrase)):
        over = [query.column] if query.column else list(columns)
        if not over:
            raise TableError("no text column to search")
        parts = [(_match if isinstance(query, Match) else _phrase)(found[c], query) for c in over]
        return _best(parts, key)
    if isinstance(query, MultiMatch):
        return _best([_match(found[c], q) for c, q in _matches(query)], key)
    if isinstance(query, Boost):
        minus = again(query.negative).withColumnRenamed(SCORE, "_minus")
        return again(query.positive).join(minus, key, "left").select(key, (F.col(SCORE) - query.negative_boost * F.coalesce("_minus", F.lit(0.0))).alias(SCORE))
    if isinstance(query, Boolean):
        if not query.must and not query.should:
            raise TableError("a boolean query needs must or should")
        out = None
        for q in query.must:
            part = again(q)
            out = part if out is None else out.join(part.withColumnRenamed(SCORE, "_more"), key).select(key, (F.col(SCORE) + F.col("_more")).alias(SCORE))
        optional = None
        for q in query.should:
            optional = again(q) if optional is None else optional.unionByName(again(q))
        if optional is not None:
            optional = optional.groupBy(key).agg(F.sum(SCORE).alias(SCORE))
            out = optional if out is None else out.join(optional.withColumnRenamed(SCORE, "_more"), key, "left").select(key, (F.col(SCORE) + F.coalesce("_more", F.lit(0.0))).alias(SCORE))
        for q in query.must_not:
            out = out.join(again(q).select(key), key, "left_anti")
        return out
    raise TableError(f"not a query: {query!r}")


def _best(parts: list[DataFrame], key: str) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if len(parts) == 1 else out.groupBy(key).agg(F.max(SCORE).alias(SCORE))


def search(df: DataFrame, query, columns: Sequence[str], limit: int | None = None, key: str = ROWID, analyzer: Analyzer = Analyzer(), stored: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows a query finds with `_score`; with a limit, the best so many are chosen before the rows are fetched."""
    top = scores(df, query, columns, key, analyzer, stored)
    if limit is not None:
        top = top.orderBy(F.col(SCORE).desc(), key).limit(limit)
    return df.join(top, key)


def idf(rows: int, having: int) -> float:
    return math.log((rows - having + 0.5) / (having + 0.5) + 1)
