import duckdb
import pandas as pd
import pytest

from loomwright.llm.mixing import mix, mix_report, mix_sql

from . import brute


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_oracle_and_nears_its_targets(spark, seed):
    rows = [r for r in brute.corpus(seed, 120)]
    docs = spark.createDataFrame(rows, brute.SCHEMA).repartition(3)
    got = [tuple(r) for r in mix_report(docs).collect()]
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.execute(mix_sql()).fetchall()
    fix = lambda rs: sorted(((a, b, c, round(d, 6), e) for a, b, c, d, e in rs), key=repr)
    # rows that share an id are joined once each by both
    assert set(fix(got)) == set(fix(want))
    source = {r[0]: r[3] for r in rows}
    taken, target, largest = {}, {}, {}
    for i, size, _, t, k in got:
        s = source[i]
        taken[s] = taken.get(s, 0) + k
        target[s], largest[s] = t, max(largest.get(s, 0), size)
        assert k <= 2 * size
    # two rows with one id count as one document of both sizes
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] + 1 for s in taken if s is not None)


def test_mix_repeats_whole_documents(spark):
    rows = [(i, "w " * 10, "x", "a" if i % 3 else "b", 20) for i in range(300)]
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    report = {r["doc_id"]: r["taken"] // 10 for r in mix_report(docs).collect()}
    mixed = mix(docs)
    assert mixed.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: v for k, v in report.items() if v}


def test_empty_table(spark):
    docs = spark.createDataFrame([], brute.SCHEMA)
    assert mix_report(docs).count() == 0 and mix(docs).count() == 0


def test_names_of_the_recipe_and_sources_without_words(spark):
    rows = [(i, "some words here", "a", i, "e", i, "f", "s") for i in range(20)] + [(50, "", "b", 1, "e", 1, "f", "s"), (51, None, "b", 1, "e", 1, "f", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, whole long, edge_key string, edge_cell long, full_cell string, _s string")
    got = mix(docs)
    assert got.columns == docs.columns
    assert {r["source"] for r in got.collect()} == {"a"} and got.count() == 30
