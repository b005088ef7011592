import pytest

from loomwright.llm.substring import remove_repeats

from . import brute

COLS = ["doc_id", "n_words", "n_removed", "kept_sha256"]


@pytest.mark.parametrize("seed", [2])
def test_equals_brute_force(spark, seed):
    rows = brute.corpus(seed)
    got = remove_repeats(spark.createDataFrame(rows, brute.SCHEMA).repartition(5)).select(COLS).collect()
    assert brute.order(got) == brute.order(brute.repeats(rows))


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = remove_repeats(docs).select(COLS).collect()
    assert brute.order(got) == brute.order(brute.repeats(rows))
    assert sum(r["n_removed"] for r in got) > 0


def test_owner_between_two_documents_of_another_batch(spark):
    new = (f"w{i}" for i in range(10_000))
    some = lambda k: [next(new) for _ in range(k)]
    passage = some(50)
    texts = [(1, some(7) + passage[15:40] + some(40)), (3, some(5) + passage + some(10)), (2, some(10) + passage + some(15)), (4, some(60))]
    rows = [(i, " ".join(w), None, None, 0) for i, w in texts]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), brute.SCHEMA)
    got = remove_repeats(docs).select(COLS).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {1: 0, 2: 0, 3: 50, 4: 0}
    assert brute.order(got) == brute.order(brute.repeats(rows))


def test_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([], brute.SCHEMA + ", id long, hits string, bucket int")
    assert remove_repeats(docs).count() == 0
    rows = [(1, "a " * 60, "x", "y", 1, 9, "h", 3), (2, "a " * 60, "x", "y", 1, 9, "h", 3)]
    docs = spark.createDataFrame(rows, brute.SCHEMA + ", id long, hits string, bucket int")
    assert brute.order(remove_repeats(docs).select(COLS).collect()) == brute.order(brute.repeats(rows))


def test_texts_longer_than_a_slab_and_ids_that_are_no_integers(spark):
    long = " ".join(f"w{i % 9000}" for i in range(40_000))
    rows = [(1, long, None, None, 0), (2, "start " + long[1000:3000], None, None, 0), (None, None, None, None, 0)]
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    assert brute.order(remove_repeats(docs).select(COLS).collect()) == brute.order(brute.repeats(rows))
    assert "kept" not in remove_repeats(docs, texts=False).columns
    with pytest.raises(TypeError):
        remove_repeats(spark.createDataFrame([("x", "t")], "doc_id string, text string"))
