import numpy as np
import pytest

from loomwright.llm.phrases import SIZE, suffix_ranks
from loomwright.llm.suffix_dedup import remove_repeated_bytes

from . import brute

COLS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize("seed", [2])
def test_equals_brute_force(spark, seed):
    rows = brute.corpus(seed)
    rows += [(20_001 + k, "ab" * 300 + "x" * k, None, None, 0) for k in range(3)] + [(20_010, "q" * 199, None, None, 0), (20_011, "q" * 200, None, None, 0)]
    got = remove_repeated_bytes(spark.createDataFrame(rows, brute.SCHEMA).repartition(5)).select(COLS).collect()
    assert brute.order(got) == brute.order(brute.byte_repeats(rows))


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = remove_repeated_bytes(docs).select(COLS).collect()
    assert brute.order(got) == brute.order(brute.byte_repeats(rows))


def test_suffix_ranks_are_the_order_of_the_strings():
    r = np.random.default_rng(5)
    data = np.concatenate([r.integers(97, 99, 900), np.tile(r.integers(97, 99, 260), 3)]).astype(np.uint8)
    starts = np.arange(len(data) - SIZE + 1)
    strings = [data[s : s + SIZE].tobytes() for s in starts]
    order = {s: i for i, s in enumerate(sorted(set(strings)))}
    assert suffix_ranks(data, starts).tolist() == [order[s] for s in strings]


def test_empty_table(spark):
    assert remove_repeated_bytes(spark.createDataFrame([], brute.SCHEMA)).count() == 0


def test_texts_longer_than_a_slab_and_ids_that_are_no_integers(spark):
    long = " ".join(f"w{i % 9000}" for i in range(40_000))
    rows = [(1, long, None, None, 0), (2, "start " + long[1000:3000], None, None, 0), (None, None, None, None, 0)]
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    assert brute.order(remove_repeated_bytes(docs).select(COLS).collect()) == brute.order(brute.byte_repeats(rows))
    assert "kept" not in remove_repeated_bytes(docs, texts=False).columns
    with pytest.raises(TypeError):
        remove_repeated_bytes(spark.createDataFrame([("x", "t")], "doc_id string, text string"))
