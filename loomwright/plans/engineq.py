"""Queries through the engine's own API, each with the SQL that says what must come out."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import distance as D
from ..functions import json as J
from ..operators import batches, evolve, fts, indices, maintain, mutate, sampling, vector
from ..operators.scanner import Scanner
from ..sources.store import scratch
from ..sources.table import CREATED, DISTANCE, OFFSET, ROWID, SCORE, SYSTEM, Table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
LOADS = [0.0]


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, sf_dir: str, name: str, rows: DataFrame | None = None) -> Table:
    """A fresh versioned table of a source's rows. `LOADS` sums the seconds that writing takes, for the bench."""
    began = time.time()
    table = Table.write(read(spark, sf_dir, name) if rows is None else rows, scratch(spark))
    LOADS[0] += time.time() - began
    return table


# -- scans ------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey AS key, l_quantity * 2 + l_linenumber AS q, l_orderkey // l_linenumber AS d, upper(l_returnflag) AS flag FROM lineitem WHERE l_quantity >= 10 AND l_discount < 0.05 ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 500")
def scan_project_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"key": "l_orderkey", "q": "l_quantity * 2 + l_linenumber", "d": "l_orderkey / l_linenumber", "flag": "upper(l_returnflag)"}
    order = [("l_extendedprice", False, False), "l_orderkey", "l_linenumber"]
    return Scanner(stored(spark, sf_dir, "lineitem"), columns=columns, filter="l_quantity >= 10 AND l_discount < 0.05", order_by=order, limit=500).to_df()


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY nullif(o_custkey % 7, 3) DESC NULLS LAST, o_orderkey LIMIT 40 OFFSET 15")
def scan_order_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").withColumn("k", F.expr("nullif(o_custkey % 7, 3)"))
    return Scanner(stored(spark, sf_dir, "orders", rows), columns=["o_orderkey", "o_custkey"], order_by=[("k", False, False), "o_orderkey"], limit=40, offset=15).to_df()


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (3, 5, 8) ORDER BY c_custkey")
def take_rowids(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored(spark, sf_dir, "customer")
    ids = [r[0] for r in table.scan().filter("c_custkey IN (3, 5, 8)").select(ROWID).collect()]
    return table.take_rows(ids, ["c_custkey", "c_name"])


@query("SELECT unnest([7, 2, 2, 40]) AS c_custkey")
def take_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored(spark, sf_dir, "customer", read(spark, sf_dir, "customer").orderBy("c_custkey"))
    return table.take([7, 2, 2, 40], ["c_custkey"])


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS place, c_custkey FROM customer WHERE c_custkey % 3 <> 0")
def row_offsets_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored(spark, sf_dir, "customer", read(spark, sf_dir, "customer").repartitionByRange(3, "c_custkey").sortWithinPartitions("c_custkey"))
    mutate.delete(table, "c_custkey % 3 = 0")
    return table.with_offsets().select(F.col(OFFSET).alias("place"), "c_custkey")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 3 = 0) AS gone FROM customer")
def scan_include_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored(spark, sf_dir, "customer")
    mutate.delete(table, "c_custkey % 3 = 0")
    return Scanner(table, columns=["c_custkey"], with_row_id=True, include_deleted=True).to_df().agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(ROWID).isNull(), 1)).alias("gone"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS v FROM events WHERE value > 5 GROUP BY event_type")
def table_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "events").sql("SELECT event_type, count(*) AS n, round(sum(value), 2) AS v FROM dataset WHERE value > 5 GROUP BY event_type")


# -- JSON ----------------------------------------------------------------------------------------------------

_DOC = "concat('{\"k\": ', event_id % 7, ', \"user\": {\"name\": \"u', user_id, '\"}, \"tags\": [\"', event_type, '\", \"x\"], \"ok\": ', CASE WHEN value > 5 THEN 'true' ELSE 'false' END, ', \"none\": null, \"f\": 1.5}')"
_DUCK_DOC = _DOC.replace("event_id % 7", "CAST(event_id % 7 AS VARCHAR)").replace("user_id,", "CAST(user_id AS VARCHAR),")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", J.json_extract(F.col("props"), "$.k").alias("k"))


@query(f"SELECT event_id, CAST(json_extract(j, '$.user.name') AS VARCHAR) AS name, json_exists(j, '$.none') AS e1, json_exists(j, '$.gone') AS e2, CAST(json_extract(j, '$.k') AS BIGINT) AS i, CAST(json_extract(j, '$.f') AS DOUBLE) AS f, CAST(json_extract_string(j, '$.ok') AS BOOLEAN) AS b, list_contains(json_extract_string(j, '$.tags[*]'), 'click') AS has, CAST(json_array_length(j, '$.tags') AS BIGINT) AS n, json_extract_string(j, '$.tags[0]') AS first FROM (SELECT event_id, {_DUCK_DOC} AS j FROM events)")
def json_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.col("j")
    return read(spark, sf_dir, "events").select("event_id", F.expr(_DOC).alias("j")).select(
        "event_id", J.json_extract(j, "$.user.name").alias("name"), J.json_exists(j, "$.none").alias("e1"), J.json_exists(j, "$.gone").alias("e2"), J.json_get_int(j, "k").alias("i"), J.json_get_float(j, "f").alias("f"),
        J.json_get_bool(j, "ok").alias("b"), J.json_array_contains(j, "$.tags", "click").alias("has"), J.json_array_length(j, "$.tags").alias("n"), F.get_json_object("j", "$.tags[0]").alias("first"),
    )


@query(f"SELECT event_id, CASE json_type(j, '$.' || p) WHEN 'NULL' THEN 0 WHEN 'BOOLEAN' THEN 1 WHEN 'UBIGINT' THEN 2 WHEN 'DOUBLE' THEN 3 WHEN 'VARCHAR' THEN 4 WHEN 'ARRAY' THEN 5 WHEN 'OBJECT' THEN 6 END AS tag, p FROM (SELECT event_id, {_DUCK_DOC} AS j FROM events), (SELECT unnest(['none', 'ok', 'k', 'f', 'tags', 'user', 'gone']) AS p)")
def json_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", F.expr(_DOC).alias("j"))
    tags = [F.struct(J.json_extract_with_type(F.col("j"), f"$.{p}").getField("type_tag").alias("tag"), F.lit(p).alias("p")) for p in ("none", "ok", "k", "f", "tags", "user", "gone")]
    return rows.select("event_id", F.explode(F.array(*tags)).alias("x")).select("event_id", "x.tag", "x.p")


# -- vectors ---------------------------------------------------------------------------------------------------

_Q = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)"
_E = "CAST(embedding AS DOUBLE[])"
_METRIC = {"l2": f"list_distance({_E}, {_Q}) ** 2", "cosine": f"list_cosine_distance({_E}, {_Q})", "dot": f"1 - list_inner_product({_E}, {_Q})"}


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    df = read(spark, sf_dir, "embeddings")
    return df, list(df.filter("vec_id = 7").first()["embedding"])


def _knn(metric: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, q = _vectors(spark, sf_dir)
        return vector.flat(df, "embedding", q, 20, metric, tie="vec_id").select("vec_id", (F.round(DISTANCE, 5) + 0.0).alias("d"))

    run.__name__ = f"knn_{metric}"
    return run


for _m, _sql in _METRIC.items():
    query(f"SELECT vec_id, round({_sql}, 5) + 0.0::DOUBLE AS d FROM embeddings ORDER BY {_sql}, vec_id LIMIT 20")(_knn(_m))


@query(f"SELECT vec_id, round({_METRIC['l2']}, 5) AS d FROM embeddings WHERE {_METRIC['l2']} >= 1.0 AND {_METRIC['l2']} < 120.0 ORDER BY {_METRIC['l2']}, vec_id LIMIT 50")
def knn_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, q = _vectors(spark, sf_dir)
    return vector.flat(df, "embedding", q, 50, "l2", (1.0, 120.0), "vec_id").select("vec_id", F.round(DISTANCE, 5).alias("d"))


@query(f"SELECT vec_id FROM embeddings WHERE label = 3 ORDER BY {_METRIC['l2']}, vec_id LIMIT 10")
def knn_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, q = _vectors(spark, sf_dir)
    return Scanner(stored(spark, sf_dir, "embeddings"), columns=["vec_id"], filter="label = 3", prefilter=True, nearest={"column": "embedding", "q": q, "k": 10}).to_df().select("vec_id")


@query(f"SELECT vec_id FROM (SELECT vec_id, label FROM embeddings ORDER BY {_METRIC['l2']}, vec_id LIMIT 60) t WHERE label = 3")
def knn_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, q = _vectors(spark, sf_dir)
    return Scanner(stored(spark, sf_dir, "embeddings"), columns=["vec_id"], filter="label = 3", nearest={"column": "embedding", "q": q, "k": 60}).to_df().select("vec_id")


_BITS = "list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)"


@query(f"WITH b AS (SELECT vec_id, {_BITS} AS v FROM embeddings), q AS (SELECT v AS w FROM b WHERE vec_id = 7) SELECT vec_id, CAST(list_sum(list_transform(list_zip(v, w), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS DOUBLE) AS d FROM b, q ORDER BY d, vec_id LIMIT 20")
def knn_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0)).alias("v"))
    q = df.filter("vec_id = 7").first()["v"]
    return vector.flat(df, "v", q, 20, "hamming", tie="vec_id").select("vec_id", F.col(DISTANCE).alias("d"))


@query(f"SELECT qid, vec_id, rank FROM (SELECT q.vec_id AS qid, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.vec_id >= 0) WHERE rank <= 5")
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "embeddings")
    found = vector.batch(df, "embedding", df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"), "qid", "embedding", 5, key="vec_id")
    return found.select("qid", "vec_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH q AS (SELECT vec_id AS q, {_E} AS w FROM embeddings WHERE vec_id IN (7, 8)), s AS (SELECT label, q, max(1 - list_cosine_distance({_E}, w)) AS m FROM embeddings, q GROUP BY label, q) SELECT label, round(1 - sum(m), 5) AS d FROM s GROUP BY label")
def knn_multivector(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "embeddings")
    q = [r["embedding"] for r in df.filter("vec_id IN (7, 8)").orderBy("vec_id").collect()]
    rows = df.groupBy("label").agg(F.collect_list("embedding").alias("vectors"))
    return vector.flat_multivector(rows, "vectors", q, 100, "cosine", tie="label").select("label", F.round(DISTANCE, 5).alias("d"))


@query(f"WITH q AS (SELECT vec_id AS q, {_E} AS w FROM embeddings WHERE vec_id IN (7, 8)), s AS (SELECT label, q, max(1 - list_cosine_distance({_E}, w)) AS m FROM embeddings, q GROUP BY label, q), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY m DESC, label) AS rk FROM s) WHERE rk <= 4), l AS (SELECT q, min(m) AS least FROM t GROUP BY q), c AS (SELECT DISTINCT label FROM t) SELECT c.label, round(2 - sum(coalesce(t.m, l.least)), 5) AS d FROM c CROSS JOIN l LEFT JOIN t ON t.label = c.label AND t.q = l.q GROUP BY c.label")
def knn_multivector_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "embeddings")
    q = [r["embedding"] for r in df.filter("vec_id IN (7, 8)").orderBy("vec_id").collect()]
    rows = df.groupBy("label").agg(F.collect_list("embedding").alias("vectors"))
    return vector.xtr(rows, "vectors", q, 100, 4, tie="label").select("label", F.round(DISTANCE, 5).alias("d"))


@query(f"SELECT vec_id FROM embeddings ORDER BY {_METRIC['l2']}, vec_id LIMIT 15")
def ivf_exact_all_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, q = _vectors(spark, sf_dir)
    table = stored(spark, sf_dir, "embeddings")
    indices.create_vector_index(table, "embedding", "IVF_FLAT", partitions=8)
    return Scanner(table, columns=["vec_id"], nearest={"column": "embedding", "q": q, "k": 15, "nprobes": 8}).to_df().select("vec_id")


@query(f"SELECT vec_id FROM embeddings ORDER BY {_METRIC['l2']}, vec_id LIMIT 15")
def ivf_index_plus_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, q = _vectors(spark, sf_dir)
    table = stored(spark, sf_dir, "embeddings", df.filter("vec_id % 2 = 0"))
    indices.create_vector_index(table, "embedding", "IVF_FLAT", partitions=4)
    table.append(df.filter("vec_id % 2 = 1"))
    return Scanner(table, columns=["vec_id"], nearest={"column": "embedding", "q": q, "k": 15, "nprobes": 4}).to_df().select("vec_id")


def _quantised(kind: str, **more) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Whether recall at 10 reaches 0.9 against the exact search, for every query of an id divisible by 20."""
        table = stored(spark, sf_dir, "embeddings")
        indices.create_vector_index(table, "embedding", kind, partitions=8, **more)
        model, lists = indices.load_vector(table, indices.find(table, "embedding", "vector"))
        rows = table.scan()
        asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
        truth = vector.batch(rows, "embedding", asked, "qid", "embedding", 10).select("qid", ROWID)
        found = vector.search_batch(rows, lists, model, "embedding", asked, "qid", "embedding", 10, nprobes=7, refine=10).select("qid", ROWID, F.lit(1).alias("hit"))
        per = truth.join(found, ["qid", ROWID], "left").groupBy("qid").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
        return per.agg(F.count(F.lit(1)).alias("n"), (F.avg("recall") >= 0.9).alias("recalled"))

    run.__name__ = {"IVF_FLAT": "ivf_flat_recall", "IVF_PQ": "ivf_pq_refine_recall", "IVF_SQ": "ivf_sq_recall", "IVF_RQ": "ivf_rq_recall"}[kind]
    return run


for _k in ("IVF_FLAT", "IVF_PQ", "IVF_SQ", "IVF_RQ"):
    query("SELECT count(*) AS n, TRUE AS recalled FROM embeddings WHERE vec_id % 20 = 0")(_quantised(_k))


@query(f"SELECT vec_id FROM embeddings WHERE label = 3 ORDER BY {_METRIC['l2']}, vec_id LIMIT 10")
def ivf_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter before the search: the index ranks allowed rows only, so k of them come back."""
    _, q = _vectors(spark, sf_dir)
    table = stored(spark, sf_dir, "embeddings")
    indices.create_vector_index(table, "embedding", "IVF_PQ", partitions=8)
    return Scanner(table, columns=["vec_id"], filter="label = 3", prefilter=True, nearest={"column": "embedding", "q": q, "k": 10, "nprobes": 8, "refine": 40}).to_df().select("vec_id")


@query(f"SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0 ORDER BY {_METRIC['l2']}, vec_id LIMIT 15")
def ivf_fast_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what the index covers."""
    df, q = _vectors(spark, sf_dir)
    table = stored(spark, sf_dir, "embeddings", df.filter("vec_id % 2 = 0"))
    indices.create_vector_index(table, "embedding", "IVF_FLAT", partitions=4)
    table.append(df.filter("vec_id % 2 = 1"))
    return Scanner(table, columns=["vec_id"], fast_search=True, nearest={"column": "embedding", "q": q, "k": 15, "nprobes": 4}).to_df().select("vec_id")


@query("SELECT count(*) AS n, count(*) AS nearest FROM embeddings")
def kmeans_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows stand in the partition of their nearest centre, as built-in functions measure it."""
    df = read(spark, sf_dir, "embeddings")
    model = vector.train(df, "embedding", 6)
    placed = vector.assign(df, "embedding", model, "vec_id").select("vec_id", "part_id")
    own = F.array_min(F.array(*(F.struct(D.distance("l2", F.col("embedding"), D.literal(c.tolist())).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(model.centres))))
    return df.join(placed, "vec_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(own["i"] == F.col("part_id"), 1)).alias("nearest"))


# -- text -----------------------------------------------------------------------------------------------------

_TOK = "list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' AND length(x) <= 40)"
_BASE = f"""d AS (SELECT doc_id, {_TOK.format(c='text')} AS w FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n, avg(len(w)) AS av FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(len(w)) AS dl FROM (SELECT doc_id, w, unnest(w) AS term FROM d) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
b AS (SELECT doc_id, term, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av)) AS s FROM tf JOIN df USING (term), st)"""


def _find(q, columns=("text",)) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fts.scores(read(spark, sf_dir, "documents"), q, list(columns), key="doc_id").select("doc_id", F.round(SCORE, 5).alias("score"))

    return run


def _text(name: str, q, sql: str) -> None:
    f = _find(q)
    f.__name__ = name
    query(f"WITH {_BASE} {sql}")(f)


_text("fts_match_or", fts.Match("haon was"), "SELECT doc_id, round(sum(s), 5) AS score FROM b WHERE term IN ('haon', 'was') GROUP BY doc_id")
_text("fts_match_and", fts.Match("the of and", operator="and"), "SELECT doc_id, round(sum(s), 5) AS score FROM b WHERE term IN ('the', 'of', 'and') GROUP BY doc_id HAVING count(*) = 3")
_text("fts_boosted_match", fts.Match("haon", boost=2.5, fuzziness=0), "SELECT doc_id, round(2.5 * sum(s), 5) AS score FROM b WHERE term = 'haon' GROUP BY doc_id")
_text("fts_phrase", fts.Phrase("of the"), "SELECT doc_id, round(sum(s), 5) AS score FROM b WHERE term IN ('of', 'the') AND doc_id IN (SELECT doc_id FROM d WHERE len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) > 0) GROUP BY doc_id")
_text("fts_phrase_slop", fts.Phrase("the of the", slop=2), "SELECT doc_id, round(sum(s), 5) AS score FROM b WHERE term IN ('of', 'the') AND doc_id IN (SELECT doc_id FROM d WHERE len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'the' AND len(list_filter(range(i + 1, i + 4), lambda j: w[j] = 'of' AND list_contains(w[j + 1:j + 3], 'the'))) > 0)) > 0) GROUP BY doc_id")
_text("fts_boost", fts.Boost(fts.Match("the"), fts.Match("of"), 0.3), "SELECT p.doc_id, round(p.s - 0.3 * coalesce(m.s, 0), 5) AS score FROM (SELECT * FROM b WHERE term = 'the') p LEFT JOIN (SELECT * FROM b WHERE term = 'of') m USING (doc_id)")
_text("fts_boolean", fts.Boolean([fts.Match("the")], [fts.Match("with")], [fts.Match("idiot")]), "SELECT p.doc_id, round(p.s + coalesce(o.s, 0), 5) AS score FROM (SELECT * FROM b WHERE term = 'the') p LEFT JOIN (SELECT * FROM b WHERE term = 'with') o USING (doc_id) WHERE p.doc_id NOT IN (SELECT doc_id FROM b WHERE term = 'idiot')")
_text("fts_fuzzy", fts.Match("therea", fuzziness=1, max_expansions=1000), "SELECT doc_id, round(sum(s), 5) AS score FROM b WHERE levenshtein(term, 'therea') <= 1 GROUP BY doc_id")
_text("fts_json_query", '{"boolean": {"must": [{"match": {"terms": "and", "column": "text"}}], "must_not": [{"match": {"terms": "the", "column": "text"}}]}}', "SELECT doc_id, round(s, 5) AS score FROM b WHERE term = 'and' AND doc_id NOT IN (SELECT doc_id FROM b WHERE term = 'the')")


@query("""WITH d AS (SELECT doc_id, c, CASE c WHEN 'lang' THEN [lang] ELSE list_filter(regexp_split_to_array(lower(source), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') END AS w FROM documents, (SELECT unnest(['lang', 'source']) AS c)),
st AS (SELECT c, count(*) AS n, avg(len(w)) AS av FROM d GROUP BY c), tf AS (SELECT doc_id, c, term, count(*) AS tf, any_value(len(w)) AS dl FROM (SELECT doc_id, c, w, unnest(w) AS term FROM d) GROUP BY doc_id, c, term),
df AS (SELECT c, term, count(*) AS df FROM tf GROUP BY c, term), b AS (SELECT doc_id, c, term, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av)) AS s FROM tf JOIN df USING (c, term) JOIN st USING (c))
SELECT doc_id, round(max(t), 5) AS score FROM (SELECT doc_id, c, sum(s) * CASE c WHEN 'lang' THEN 2.0 ELSE 1.0 END AS t FROM b WHERE term IN ('de', 'src7') GROUP BY doc_id, c) GROUP BY doc_id""")
def fts_multi_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = fts.MultiMatch("de src7", ["lang", "source"], [2.0, 1.0])
    return fts.scores(read(spark, sf_dir, "documents"), q, [], key="doc_id").select("doc_id", F.round(SCORE, 5).alias("score"))


@query(f"WITH {_BASE.replace('WHERE text IS NOT NULL', chr(39).join(['WHERE text IS NOT NULL AND lang = ', 'de', '']))} SELECT doc_id, round(sum(s), 5) AS score FROM b WHERE term IN ('und', 'der') GROUP BY doc_id ORDER BY sum(s) DESC, doc_id LIMIT 20")
def fts_with_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored(spark, sf_dir, "documents", read(spark, sf_dir, "documents").orderBy("doc_id"))
    return Scanner(table, columns=["doc_id"], filter="lang = 'de'", prefilter=True, full_text="und der", full_text_columns=["text"], limit=20).to_df().select("doc_id", F.round(SCORE, 5).alias("score"))


@query(f"WITH {_BASE} SELECT doc_id, round(sum(s), 5) AS score FROM b WHERE term IN ('the', 'haon') GROUP BY doc_id")
def fts_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored(spark, sf_dir, "documents")
    indices.create_scalar_index(table, "text", "INVERTED")
    rows = table.scan()
    top = fts.scores(rows, fts.Match("the haon"), ["text"], stored=indices.stored_postings(table, ["text"]))
    return rows.join(top, ROWID).select("doc_id", F.round(SCORE, 5).alias("score"))


@query(f"WITH {_BASE} SELECT doc_id, round(sum(s), 5) AS score FROM b WHERE term IN ('of', 'the') AND doc_id IN (SELECT doc_id FROM d WHERE len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) > 0) GROUP BY doc_id")
def fts_phrase_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase by the positions of an inverted index, through the scanner."""
    table = stored(spark, sf_dir, "documents")
    indices.create_scalar_index(table, "text", "INVERTED")
    return Scanner(table, columns=["doc_id"], full_text=fts.Phrase("of the"), full_text_columns=["text"]).to_df().select("doc_id", F.round(SCORE, 5).alias("score"))


@query("SELECT doc_id FROM documents WHERE contains(text, 'erthat')")
def ngram_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored(spark, sf_dir, "documents")
    indices.create_scalar_index(table, "text", "NGRAM")
    return indices.lookup(table, "text", "contains", "erthat").select("doc_id")


# -- scalar indices -----------------------------------------------------------------------------------------------


def _indexed(kind: str, op: str, value, source: str, column: str, out: str, rows: Callable | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, source)
        df = rows(df) if rows else df
        table = stored(spark, sf_dir, source, df.filter(F.col(out) % 5 != 0))
        indices.create_scalar_index(table, column, kind)
        table.append(df.filter(F.col(out) % 5 == 0))  # rows that the index doesn't cover
        return indices.lookup(table, column, op, value).select(out)

    return run


def _index(name: str, sql: str, *args, **kw) -> None:
    f = _indexed(*args, **kw)
    f.__name__ = name
    query(sql)(f)


_index("index_btree_range", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 30000", "BTREE", "between", (1000, 30000), "orders", "o_totalprice", "o_orderkey")
_index("index_btree_null", "SELECT o_orderkey FROM orders WHERE o_custkey % 9 = 4", "BTREE", "is null", None, "orders", "k", "o_orderkey", lambda d: d.withColumn("k", F.expr("nullif(o_custkey % 9, 4)")))
_index("index_bitmap_in", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')", "BITMAP", "in", ["F", "P"], "orders", "o_orderstatus", "o_orderkey")
_index("index_bloom_equality", "SELECT o_orderkey FROM orders WHERE o_custkey = 42", "BLOOMFILTER", "=", 42, "orders", "o_custkey", "o_orderkey")
_index("index_zonemap_range", "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000", "ZONEMAP", ">", 250000, "orders", "o_totalprice", "o_orderkey")
_LABELS = lambda d: d.withColumn("labels", F.array(F.col("label"), F.col("label") + 1, F.col("label") * 2))
_index("label_list_any", "SELECT vec_id FROM embeddings WHERE list_has_any([label, label + 1, label * 2], [4, 9])", "LABEL_LIST", "has any", [4, 9], "embeddings", "labels", "vec_id", rows=_LABELS)
_index("label_list_all", "SELECT vec_id FROM embeddings WHERE list_has_all([label, label + 1, label * 2], [4, 5])", "LABEL_LIST", "has all", [4, 5], "embeddings", "labels", "vec_id", rows=_LABELS)


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 30")
def index_json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored(spark, sf_dir, "events")
    indices.create_scalar_index(table, "props", "BTREE", json_path="k")
    return Scanner(table, columns=["event_id"], filter="json_get_int(props, 'k') = 30").to_df()



@query("SELECT zone, min(l_quantity) AS low, max(l_quantity) AS high, count(*) AS n, CAST(0 AS BIGINT) AS nulls FROM (SELECT l_quantity, (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_extendedprice) - 1) // 8192 AS zone FROM lineitem) GROUP BY zone")
def zone_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones of places: the table has as many fragments as its sort had tasks."""
    rows = read(spark, sf_dir, "lineitem").orderBy("l_orderkey", "l_linenumber", "l_extendedprice")
    places = stored(spark, sf_dir, "lineitem", rows).with_offsets().withColumn(ROWID, F.col(OFFSET))
    zones = indices.ZoneMap().build(places, "l_quantity")
    return zones.select("zone", "low", "high", F.col("rows").alias("n"), "nulls")


def _filtered(name: str, sql: str, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A filter that meets three indices, over rows that they cover and rows that they don't."""
        df = read(spark, sf_dir, "orders")
        table = stored(spark, sf_dir, "orders", df.filter("o_orderkey % 5 <> 0"))
        for column, kind in (("o_totalprice", "BTREE"), ("o_orderstatus", "BITMAP"), ("o_custkey", "ZONEMAP")):
            indices.create_scalar_index(table, column, kind)
        table.append(df.filter("o_orderkey % 5 = 0"))
        return Scanner(table, columns=["o_orderkey"], filter=where).to_df()

    run.__name__ = name
    query(f"SELECT o_orderkey FROM orders WHERE {sql}")(run)


for _n, _w in (
    ("filter_index_point", "o_totalprice BETWEEN 1000 AND 1500"), ("filter_index_and", "o_totalprice < 60000 AND o_orderstatus = 'F'"), ("filter_index_or", "o_totalprice < 3000 OR o_orderstatus = 'P'"),
    ("filter_index_not", "NOT (o_orderstatus = 'F') AND o_totalprice > 100000"), ("filter_index_recheck", "o_custkey = 42 AND o_orderpriority LIKE '1%'"), ("filter_index_mixed", "o_custkey < 20 OR o_totalprice > 480000"),
):
    _filtered(_n, _w, _w)


@query("SELECT c_custkey FROM customer WHERE (CASE WHEN c_custkey % 4 = 0 THEN -1.0 ELSE c_acctbal END) = -1.0")
def index_after_update_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored(spark, sf_dir, "customer")
    indices.create_scalar_index(table, "c_acctbal", "BTREE")
    mutate.update_columns(table, read(spark, sf_dir, "customer").filter("c_custkey % 4 = 0").select("c_custkey", F.lit(-1.0).alias("c_acctbal")), "c_custkey")
    return Scanner(table, columns=["c_custkey"], filter="c_acctbal = -1.0").to_df()


# -- mutations and versions -----------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT coalesce(nullif(o_custkey % 5, 2) > 2, FALSE)")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored(spark, sf_dir, "orders")
    mutate.delete(table, "nullif(o_custkey % 5, 2) > 2")
    return table.to_df(["o_orderkey", "o_totalprice"])


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN upper(c_name) ELSE c_name END AS c_name FROM customer")
def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored(spark, sf_dir, "customer")
    mutate.update(table, {"c_acctbal": "0", "c_name": "upper(c_name)"}, "c_acctbal < 0")
    return table.to_df(["c_custkey", "c_acctbal", "c_name"])


def _people(spark: SparkSession, sf_dir: str) -> tuple[Table, DataFrame]:
    """Customers with even keys as the table; odd keys and those divisible by three, richer by 1000, as the source."""
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return stored(spark, sf_dir, "customer", df.filter("c_custkey % 2 = 0")), df.filter("c_custkey % 3 = 0 OR c_custkey % 2 = 1").withColumn("c_acctbal", F.col("c_acctbal") + 1000)


_T = "(SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 0)"
_S = "(SELECT c_custkey, c_name, c_acctbal + 1000 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 1)"


def _merge(name: str, sql: str, build: Callable) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table, source = _people(spark, sf_dir)
        build(mutate.MergeInsert(table, "c_custkey")).execute(source)
        return table.to_df()

    run.__name__ = name
    query(sql)(run)


_BOTH = f"SELECT coalesce(s.c_custkey, t.c_custkey) AS c_custkey, coalesce(s.c_name, t.c_name) AS c_name, [1] AS c_acctbal FROM {_T} t FULL JOIN {_S} s ON s.c_custkey = t.c_custkey WHERE [2]"


def _both(balance: str, rows: str) -> str:
    return _BOTH.replace("[1]", balance).replace("[2]", rows)


_merge("merge_upsert", _both("coalesce(s.c_acctbal, t.c_acctbal)", "TRUE"), lambda m: m.when_matched_update_all().when_not_matched_insert_all())
_merge("merge_insert_only", _both("coalesce(t.c_acctbal, s.c_acctbal)", "TRUE"), lambda m: m)
_merge("merge_update_if", _both("CASE WHEN t.c_custkey IS NULL OR s.c_acctbal > t.c_acctbal AND t.c_acctbal > 3000 THEN s.c_acctbal ELSE t.c_acctbal END", "TRUE"), lambda m: m.when_matched_update_all("source.c_acctbal > target.c_acctbal AND target.c_acctbal > 3000").when_not_matched_insert_all())
_merge("merge_update_only", _both("coalesce(s.c_acctbal, t.c_acctbal)", "t.c_custkey IS NOT NULL"), lambda m: m.when_matched_update_all().when_not_matched_do_nothing())
_merge("merge_delete_unmatched", _both("coalesce(s.c_acctbal, t.c_acctbal)", "s.c_custkey IS NOT NULL"), lambda m: m.when_matched_update_all().when_not_matched_insert_all().when_not_matched_by_source_delete())
_merge("merge_delete_if", _both("coalesce(s.c_acctbal, t.c_acctbal)", "s.c_custkey IS NOT NULL OR NOT t.c_acctbal < 2000"), lambda m: m.when_matched_update_all().when_not_matched_insert_all().when_not_matched_by_source_delete("c_acctbal < 2000"))


@query(f"SELECT coalesce(s.c_custkey, t.c_custkey) AS c_custkey, t.c_name AS c_name, coalesce(s.c_acctbal, t.c_acctbal) AS c_acctbal FROM {_T} t FULL JOIN {_S} s ON s.c_custkey = t.c_custkey")
def merge_sub_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, source = _people(spark, sf_dir)
    mutate.MergeInsert(table, "c_custkey").when_matched_update_all().execute(source.drop("c_name"))
    return table.to_df()


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 15")
def merge_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored(spark, sf_dir, "customer")
    mutate.merge_columns(table, read(spark, sf_dir, "nation").filter("n_nationkey < 15").select("n_nationkey", "n_name"), "c_nationkey", "n_nationkey")
    return table.to_df(["c_custkey", "n_name"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN -1.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def update_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored(spark, sf_dir, "customer")
    mutate.update_columns(table, read(spark, sf_dir, "customer").filter("c_custkey % 4 = 0").select("c_custkey", F.lit(-1.0).alias("c_acctbal")), "c_custkey")
    return table.to_df(["c_custkey", "c_acctbal"])


@query("SELECT p_partkey, p_size * 2 + 1 AS twice, upper(p_name) AS loud FROM part")
def add_column_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored(spark, sf_dir, "part")
    evolve.add_columns(table, {"twice": "p_size * 2 + 1", "loud": "upper(p_name)"})
    return table.to_df(["p_partkey", "twice", "loud"])


@query("SELECT p_partkey, CAST(NULL AS DOUBLE) AS extra, CAST(p_size AS BIGINT) * 3 AS triple FROM part")
def add_column_null_and_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow as pa
    import pyarrow.compute as pc

    table = stored(spark, sf_dir, "part")
    evolve.add_columns(table, {"extra": "cast(null as double)"})

    def triple(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pc.multiply(batch.column(0).cast(pa.int64()), 3)], ["triple"])

    evolve.add_columns_udf(table, triple, T.StructType([T.StructField("triple", T.LongType())]), ["p_size"])
    return table.to_df(["p_partkey", "extra", "triple"])


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS size_long, p_name AS title FROM part")
def alter_cast_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored(spark, sf_dir, "part")
    evolve.alter_columns(table, {"path": "p_size", "type": "bigint"}, {"path": "p_name", "name": "title"})
    evolve.alter_columns(table, {"path": "p_size", "name": "size_long"})
    return table.to_df(["p_partkey", "size_long", "title"])


@query("SELECT p_partkey, p_name, p_type, p_size, p_retailprice, p_size AS p_brand FROM part")
def drop_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored(spark, sf_dir, "part")
    evolve.drop_columns(table, ["p_brand"])
    evolve.add_columns(table, {"p_brand": "p_size"})
    return table.to_df()


@query("SELECT 1 AS version, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 2, count(*) FROM orders UNION ALL SELECT 3, count(*) FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 4, count(*) FROM orders WHERE o_orderkey % 2 = 0")
def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders")
    table = stored(spark, sf_dir, "orders", df.filter("o_orderkey % 2 = 0"))
    table.append(df.filter("o_orderkey % 2 <> 0"))
    mutate.delete(table, "o_orderstatus = 'F'")
    table.create_tag("first", 1)
    restored = Table.open(spark, table.uri, "first").restore()
    out = None
    for v in (1, 2, 3, restored.version):
        part = table.checkout(v).scan().agg(F.lit(v).alias("version"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.union(part)
    return out


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 1")
def delta_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders")
    table = stored(spark, sf_dir, "orders", df.filter("o_orderkey % 3 <> 1"))
    table.append(df.filter("o_orderkey % 3 = 1"))
    mutate.update(table, {"o_orderstatus": "'X'"}, "o_orderkey % 3 = 2")
    return table.inserted(1, table.version).select("o_orderkey")


@query("SELECT o_orderkey, 'X' AS o_orderstatus FROM orders WHERE o_orderkey % 3 = 2")
def delta_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored(spark, sf_dir, "orders")
    mutate.update(table, {"o_orderstatus": "'X'"}, "o_orderkey % 3 = 2")
    return table.updated(1, table.version).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0")
def compaction_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored(spark, sf_dir, "orders", read(spark, sf_dir, "orders").repartition(6))
    mutate.delete(table, "o_orderkey % 7 = 0")
    before = table.scan().agg(F.sum(ROWID), F.sum(CREATED)).first()
    maintain.compact(table)
    assert table.scan().agg(F.sum(ROWID), F.sum(CREATED)).first() == before
    return table.to_df(["o_orderkey", "o_totalprice"])


@query("SELECT 'branch' AS name, count(*) AS n FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'main', count(*) FROM nation UNION ALL SELECT 'clone', 2 * count(*) FROM nation")
def branch_and_clone(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored(spark, sf_dir, "nation")
    branch = table.create_branch("trial")
    mutate.delete(branch, "n_regionkey = 1")
    clone = table.shallow_clone(scratch(spark))
    clone.append(read(spark, sf_dir, "nation"))
    count = lambda t, name: t.scan().agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
    return count(branch, "branch").union(count(table, "main")).union(count(clone, "clone"))


# -- sampling, blobs, streams ------------------------------------------------------------------------------------------


@query("SELECT 50 AS n, 50 AS distinct_rows, 50 AS known, 50 AS again")
def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample has distinct rows of the table, and is the same for the same seed."""
    table = stored(spark, sf_dir, "orders")
    one = sampling.sample(table, 50, 7, ["o_orderkey", "o_totalprice"])
    known = one.join(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey", "o_totalprice"], "left_semi").agg(F.count(F.lit(1)).alias("known"))
    again = one.join(sampling.sample(table, 50, 7, ["o_orderkey"]), "o_orderkey", "left_semi").agg(F.count(F.lit(1)).alias("again"))
    return one.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("distinct_rows")).join(known).join(again)


@query("SELECT count(*) AS n, sum(o_orderkey) AS s, 3 AS ranks FROM orders")
def sharded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored(spark, sf_dir, "orders")
    out = None
    for rank in range(3):
        part = sampling.sharded_batches(table, 16, rank, 3, seed=1).select("o_orderkey", F.lit(rank).alias("rank"))
        out = part if out is None else out.union(part)
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("s"), F.countDistinct("rank").cast("int").alias("ranks"))


@query("SELECT doc_id, octet_length(encode(text)) AS size, hex(encode(text)[3:6]) AS part FROM documents WHERE doc_id IN (1, 4, 9)")
def blob_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("blob"))
    table = stored(spark, sf_dir, "documents", rows)
    ids = table.scan().filter("doc_id IN (1, 4, 9)").select(ROWID, "doc_id")
    blobs = table.blobs("blob", [r[0] for r in ids.collect()], 2, 4)
    return blobs.join(ids, ROWID).select("doc_id", F.col("size").cast("long").alias("size"), F.hex("bytes").alias("part"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY event_type")
def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.ingest import append_stream

    df = read(spark, sf_dir, "events")
    feed = scratch(spark)
    df.repartition(3).write.parquet(feed)
    table = Table.write(df.limit(0), scratch(spark))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    append_stream(stream, table.uri, scratch(spark)).awaitTermination()
    return Table.open(spark, table.uri).to_df().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("v"))


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.ingest import upsert_stream

    df = read(spark, sf_dir, "events").select("user_id", "event_id")
    feed = scratch(spark)
    df.coalesce(1).sortWithinPartitions("event_id").write.option("maxRecordsPerFile", max(1, df.count() // 2)).parquet(feed)
    table = Table.write(df.limit(0), scratch(spark))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    upsert_stream(stream, table.uri, "user_id", scratch(spark), order="event_id").awaitTermination()
    return Table.open(spark, table.uri).to_df(["user_id", "event_id"])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_replayed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that come a second time change nothing."""
    from ..streaming.ingest import once

    df = read(spark, sf_dir, "events")
    table = Table.write(df.limit(0), scratch(spark))
    batch = once(table.uri, "s", lambda t, rows, config: t.append(rows, config=config))
    for number in (0, 0, 1, 0, 2, 1, 2):
        batch(df.filter(F.pmod("event_id", F.lit(3)) == number), number)
    return Table.open(spark, table.uri).to_df().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT date_trunc('hour', ts) AS began, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY 1, 2")
def stream_tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A windowed aggregate of a stream, written when its watermark allows; the last windows close with the stream's end."""
    from ..streaming.ingest import tumbling

    df = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    feed, out = scratch(spark), scratch(spark)
    df.coalesce(1).write.parquet(feed)
    rows = tumbling(spark.readStream.schema(df.schema).parquet(feed), "ts", "1 hour", ["event_type"], n="count(1)", most="max(value)")

    def last(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    rows.writeStream.outputMode("complete").foreachBatch(last).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    done = spark.read.parquet(out)
    return done.select(F.col("window.start").cast(read(spark, sf_dir, "events").schema["ts"].dataType).alias("began"), "event_type", "n", "most")


@query("SELECT count(*) AS n, count(*) AS ids, count(*) - 1 AS left_over FROM (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders)")
def overtaken_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers that opened the same version: every row gets an id of its own, and a delete takes the row it names."""
    df = read(spark, sf_dir, "orders")
    table = stored(spark, sf_dir, "orders")
    one, two = (Table.open(spark, table.uri) for _ in range(2))
    one.append(df.withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000))
    two.append(df.withColumn("o_orderkey", F.col("o_orderkey") + 20_000_000))
    now = Table.open(spark, table.uri)
    ids = now.scan().agg(F.count(F.lit(1)).alias("n"), F.countDistinct(ROWID).alias("ids"))
    first = df.agg(F.min("o_orderkey")).first()[0] + 20_000_000
    assert mutate.delete(now, f"o_orderkey = {first}") == 1 and now.count_rows() == now.scan().count()
    return ids.join(now.scan().agg(F.count(F.lit(1)).alias("left_over")))


@query("SELECT 'inserted' AS kind, o_orderkey FROM orders WHERE o_orderkey % 3 = 1 UNION ALL SELECT 'updated', o_orderkey FROM orders WHERE o_orderkey % 3 = 2")
def change_feed_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.ingest import poll_changes

    df = read(spark, sf_dir, "orders")
    table = stored(spark, sf_dir, "orders", df.filter("o_orderkey % 3 <> 1"))
    seen = table.version
    Table.open(spark, table.uri).append(df.filter("o_orderkey % 3 = 1"))
    mutate.update(Table.open(spark, table.uri), {"o_orderstatus": "'X'"}, "o_orderkey % 3 = 2")
    _, inserted, updated = poll_changes(table, seen)
    return inserted.select(F.lit("inserted").alias("kind"), "o_orderkey").union(updated.select(F.lit("updated"), "o_orderkey"))


@query("SELECT 'shop.orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'shop.parts', count(*) FROM part UNION ALL SELECT 'tables', 2 UNION ALL SELECT 'sql', count(*) FROM orders WHERE o_orderstatus = 'F'")
def namespace_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.namespace import Namespace

    ns = Namespace(spark, scratch(spark))
    ns.create_namespace("shop")
    ns.create_table("shop.orders", read(spark, sf_dir, "orders"))
    ns.create_table("shop.parts", read(spark, sf_dir, "part"))
    rows = [("shop.orders", ns.describe_table("shop.orders")["rows"]), ("shop.parts", ns.table("shop.parts").count_rows()), ("tables", len(ns.list_tables("shop")))]
    return spark.createDataFrame(rows, "name string, n long").union(ns.query("shop.orders", "SELECT 'sql' AS name, count(*) AS n FROM orders WHERE o_orderstatus = 'F'"))


@query("SELECT 'owner' AS entry, 'x' AS value UNION ALL SELECT 'tags', 'a,b' UNION ALL SELECT 'versions', '4' UNION ALL SELECT 'operations', 'overwrite,config,append,config' UNION ALL SELECT 'rows', CAST(2 * count(*) AS VARCHAR) FROM region")
def table_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration, tags, transactions and validation."""
    table = stored(spark, sf_dir, "region")
    table.update_config({"owner": "x", "gone": "y"})
    table.append(read(spark, sf_dir, "region"))
    table.update_config({"gone": None})
    for tag, version in (("a", 1), ("b", 3)):
        table.create_tag(tag, version)
    table.validate()
    config = table.snapshot.body["config"]
    rows = [*config.items(), ("tags", ",".join(sorted(table.tags()))), ("versions", str(len(table.versions()))), ("operations", ",".join(t["operation"] for t in table.transactions())), ("rows", str(table.count_rows()))]
    return spark.createDataFrame(rows, "entry string, value string")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 16 % 3 AS rank FROM orders")
def sharded_batches_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a seed, batches are dealt round-robin in the order of the table."""
    table = stored(spark, sf_dir, "orders", read(spark, sf_dir, "orders").orderBy("o_orderkey"))
    out = None
    for rank in range(3):
        part = sampling.sharded_batches(table, 16, rank, 3).select("o_orderkey", F.lit(rank).cast("long").alias("rank"))
        out = part if out is None else out.union(part)
    return out


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation")
def uncommitted_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two workers write fragments, one commit makes them part of the table."""
    df = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    table = Table.write(df.limit(0), scratch(spark))
    parts = table.write_uncommitted(df) + Table.open(spark, table.uri).write_uncommitted(df.withColumn("n_nationkey", F.col("n_nationkey") + 100))
    table.commit_fragments(parts).validate()
    return table.to_df()


@query("SELECT event_id, CAST(json_extract(j, '$.user') AS VARCHAR) AS user, json_extract_string(j, '$.tags[1]') AS tag, json_array_length(j, '$.tags') AS n, json_type(j, '$.k') IN ('UBIGINT', 'BIGINT') AS whole FROM (SELECT event_id, " + _DUCK_DOC + " AS j FROM events)")
def json_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON functions under their SQL names."""
    rows = read(spark, sf_dir, "events").select("event_id", F.expr(_DOC).alias("j"))
    table = Table.write(rows, scratch(spark))
    return table.sql("SELECT event_id, json_get(j, 'user') AS user, trim(BOTH '\"' FROM json_extract(j, '$.tags[1]')) AS tag, json_array_length(j, '$.tags') AS n, json_extract_with_type(j, '$.k').type_tag = 2 AS whole FROM dataset")


@query("SELECT vec_id FROM embeddings WHERE embedding[1] > 0.1 AND list_has_any([label, label + 1], [3, 8])")
def filter_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of lists count from 1; array literals stand in brackets."""
    rows = read(spark, sf_dir, "embeddings").withColumn("labels", F.array("label", F.col("label") + 1))
    return Scanner(Table.write(rows, scratch(spark)), columns=["vec_id"], filter="embedding[1] > 0.1 AND arrays_overlap(labels, [3, 8])").to_df()


@query(f"WITH {_BASE} SELECT doc_id, round(sum(s), 5) AS score FROM b WHERE term IN ('haon', 'was') GROUP BY doc_id HAVING doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def fts_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full text as a table function, filtered in SQL behind the search."""
    table = stored(spark, sf_dir, "documents")
    return table.sql("""SELECT doc_id, round(_score, 5) AS score FROM fts('dataset', '{"match": {"terms": "haon was", "column": "text"}}') WHERE lang = 'en'""")


@query("SELECT unnest([3, 4, 5, 0, 1, 4]) AS place")
def take_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "customer").select(F.col("c_custkey")).repartitionByRange(3, "c_custkey").sortWithinPartitions("c_custkey")
    first = df.agg(F.min("c_custkey")).first()[0]
    found = batches.take_ranges(stored(spark, sf_dir, "customer", df), [(3, 6), (0, 2), (4, 5)])
    return found.select((F.col("c_custkey") - first).cast("int").alias("place"))


@query(f"SELECT vec_id, label, round({_METRIC['l2']}, 5) AS d FROM embeddings ORDER BY {_METRIC['l2']}, vec_id LIMIT 12")
def late_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns fetched by row id for the rows of a search."""
    _, q = _vectors(spark, sf_dir)
    table = stored(spark, sf_dir, "embeddings")
    found = vector.flat(table.scan(), "embedding", q, 12).select(ROWID, F.round(DISTANCE, 5).alias("d"))
    return batches.fetch_columns(table, found, ["vec_id", "label"]).select("vec_id", "label", "d")


@query("SELECT c_custkey, CASE WHEN c_custkey % 50 = 1 THEN -5.0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT 9000000, -5.0")
def merge_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert whose key is indexed; a part of the table came after the index."""
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    table = stored(spark, sf_dir, "customer", df.filter("c_custkey % 4 <> 3"))
    indices.create_scalar_index(table, "c_custkey", "BTREE")
    table.append(df.filter("c_custkey % 4 = 3"))
    source = df.filter("c_custkey % 50 = 1").withColumn("c_acctbal", F.lit(-5.0)).union(spark.createDataFrame([(9_000_000, -5.0)], df.schema))
    mutate.MergeInsert(table, "c_custkey").when_matched_update_all().when_not_matched_insert_all().execute(source)
    return table.to_df()


@query("SELECT n_regionkey AS value, count(*) AS n, min(n_name) AS first FROM nation GROUP BY n_regionkey")
def group_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table split on a column, and each part read in batches of exactly four rows."""
    out = []
    for value, rows in batches.groups(stored(spark, sf_dir, "nation").to_df(), "n_regionkey"):
        parts = list(batches.strict_batches(rows.select("n_name"), 4))
        assert all(p.num_rows == 4 for p in parts[:-1])
        names = [x for p in parts for x in p.column(0).to_pylist()]
        out.append((value, len(names), min(names)))
    return spark.createDataFrame(out, "value long, n long, first string").select(F.col("value").cast(read(spark, sf_dir, "nation").schema["n_regionkey"].dataType).alias("value"), "n", "first")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


__all__ = ["D", "SYSTEM", "oracle_sql", "queries"]
