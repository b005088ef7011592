"""Operator 8: mixing sources to target weights by capped water-filling. DataFrame functions only.

Every source has a weight; together the targets come to `share` of all words. No target exceeds
`epochs` times its source: a source above that is clamped and its excess shared again by weight until
none is above. In closed form: in the order of cap / weight, the level after clamping the first k
sources is (total - their caps) / (the other weights); the greatest of those levels is the water level,
and each source gets min(cap, level * weight).

A document is taken whole `floor(target / source size)` times, and once more if it is among the first
documents, in the order of a seeded hash of its id, whose running words reach the fraction that is
left. So a source misses its target by half a document at most, and which documents are taken depends on
nothing but ids, sizes and the seed.

Running sums are not taken over whole sources: words are summed by source and hash cell (4096 cells),
and documents are ordered only inside the one cell of each source in which the fraction ends.

Defined results: null text has no words and is never taken; null is a source of its own, last in order;
rows that share an id and source are taken together; an empty table gives an empty result; other columns may bear any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, word_count

WEIGHTS = (5, 2, 1)


def draw_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def recipe(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """From (source, size, key), one row per source: source_size, target, whole repetitions, and the last
    cell and key that the fractional repetition reaches (edge_cell, edge_key)."""
    cells = cut(sizes.groupBy("source", F.substring("key", 1, 3).alias("cell")).agg(F.sum("size").alias("words")))
    total = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    # one row a source from here on: a recipe, not the corpus
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    wheel = F.array(*(F.lit(float(w)) for w in weights))
    plan = total.withColumn("weight", F.element_at(wheel, (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")))
    plan = plan.withColumn("cap", F.col("source_size") * epochs)
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    clamped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    plan = plan.withColumn("all_words", F.sum("source_size").over(everything).cast("double") * share)
    plan = plan.withColumn("level", (F.col("all_words") - clamped) / rest)
    plan = plan.withColumn("level", F.max("level").over(everything))
    plan = plan.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    size = F.col("source_size").cast("double")
    plan = plan.withColumn("whole", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("int"))
    plan = cut(plan.select("source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * size).alias("extra")))

    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    run = cells.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    edge = run.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    edge = edge.filter((F.col("before") < F.col("extra")) & (F.col("before") + F.col("words") > F.col("extra")))
    edge = cut(edge.select(F.col("source").alias("_s"), F.col("cell").alias("_c"), "before", "extra"))
    near = sizes.join(edge, F.col("source").eqNullSafe(F.col("_s")) & (F.substring("key", 1, 3) == F.col("_c")))
    near = near.groupBy("source", "_c", "before", "extra", "key").agg(F.sum("size").alias("size"))
    ahead = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = near.withColumn("mid", (F.col("before") + ahead) * 2 + F.col("size"))
    last = F.max(F.when(F.col("mid") <= F.col("extra") * 2, F.col("key")))
    reach = near.groupBy(F.col("source").alias("_s"), F.col("_c").alias("edge_cell")).agg(F.coalesce(last, F.lit("")).alias("edge_key"))
    out = plan.join(reach, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    # no cell holds the end: the fraction is nothing, or ends exactly between two cells
    full = run.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    full = full.filter((F.col("extra") > 0) & (F.col("before") + F.col("words") <= F.col("extra")))
    full = full.groupBy(F.col("source").alias("_s")).agg(F.max("cell").alias("full_cell"))
    out = out.join(full, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "extra")
    return cut(out)


def repetitions(key: Column) -> Column:
    """How often a row that `recipe` was joined to is taken."""
    cell = F.substring(key, 1, 3)
    within = (cell == F.col("edge_cell")) & (key <= F.col("edge_key"))
    return F.col("whole") + F.when(F.coalesce(cell <= F.col("full_cell"), F.lit(False)) | F.coalesce(within, F.lit(False)), 1).otherwise(0)


def mix_report(docs: DataFrame, seed: str = "mix-1", weights: Sequence[float] = WEIGHTS, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repetitions counted)."""
    sizes = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw_key(F.col("doc_id"), seed).alias("key")))
    plan = recipe(sizes, weights, share, epochs).withColumnRenamed("source", "_s")
    rows = sizes.join(plan, F.col("source").eqNullSafe(F.col("_s")))
    return rows.select("doc_id", "size", "source_size", "target", (repetitions(F.col("key")) * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, seed: str = "mix-1", weights: Sequence[float] = WEIGHTS, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with the columns that came in.

    A document without words weighs nothing in any target and goes with its key like any other; a source without a word is not taken.
    Columns may bear any name."""
    key = draw_key(F.col("doc_id"), seed)
    sizes = cut(docs.select("source", word_count(F.col("text")).alias("size"), key.alias("key")))
    plan = recipe(sizes, weights, share, epochs).withColumnRenamed("source", "_s")
    # the row as one value: names of the recipe can't clash with its own
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("source").alias("_source"), key.alias("_key"))
    rows = rows.join(plan, F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_times", repetitions(F.col("_key")))
    rows = rows.filter("_times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("_time"))
    return rows.select("row.*")


def mix_sql(seed: str = "mix-1", weights: Sequence[float] = WEIGHTS, share: float = 1.5, epochs: int = 2) -> str:
    wheel = " ".join(f"WHEN {i} THEN CAST({w} AS DOUBLE)" for i, w in enumerate(weights))
    return f"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
tot AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {wheel} END AS weight, source_size * {epochs} AS cap FROM tot),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * CAST({share} AS DOUBLE)
          - CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
          / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
m AS (SELECT *, max(lev) OVER () AS level FROM l),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), level * weight) AS target FROM m),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
g AS (SELECT source, k, sum(size) AS gsize FROM sizes GROUP BY source, k),
c AS (SELECT *, coalesce(sum(gsize) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM g)
SELECT s.doc_id, s.size, p.source_size, p.target,
       CAST(s.size * (p.whole + CASE WHEN CAST(2 * c.ahead + c.gsize AS DOUBLE) <= 2 * (p.target - p.whole * p.source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sizes s JOIN p ON s.source IS NOT DISTINCT FROM p.source
JOIN c ON c.source IS NOT DISTINCT FROM s.source AND c.k = s.k"""
