import duckdb
import pytest

import __spark_entry__


def test_names_match():
    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracle) <= set(queries)
    assert len(queries) > 100


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["tpch_q1", "tpch_q6", "join_full", "merge_upsert", "fts_phrase", "knn_l2", "json_types"])
def test_against_the_oracle(spark, sf, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("customer", "orders", "lineitem", "supplier", "events", "documents", "embeddings", "nation", "region", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in found.fetchall()), key=repr)
    got = __spark_entry__.queries()[name](spark, sf).select(names).collect()
    assert sorted((tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in got), key=repr) == want
