import re
from collections import Counter

import numpy as np

from loomwright.llm import decontam
from loomwright.llm.decontam import RADIUS, MultiIndex, decontaminate, find_leaks, fingerprints

from . import brute


def fold(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower())


def plain(rows, items):
    """Every item against every window of its size."""
    out = []
    for doc, t, *_ in rows:
        w = fold(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        have = set(grams)
        for item, text in items:
            q = fold(text)
            mine = Counter(tuple(q[i : i + 5]) for i in range(len(q) - 4))
            n = sum(mine.values())
            if not have & mine.keys():  # nothing in common: similarity 0
                continue
            best = 0.0
            for s in range(len(grams) - n + 1) if n else ():
                both = sum((Counter(grams[s : s + n]) & mine).values())
                best = max(best, both / (2 * n - both))
            if best >= 0.8:
                out.append((doc, item, round(best, 6)))
    return out


def data():
    rows = brute.corpus(7, 40)
    long = rows[3][1].split(" ")
    items = [(1, " ".join(long[100:130])), (2, " ".join(long[500:560]).upper()), (3, "one two three"), (4, None), (5, ""), (6, "never seen words in any of the texts at all"), (None, " ".join(long[700:720]))]
    near = list(long[500:560])
    near[0] = near[-1] = "other"
    far = list(long[500:560])
    far[::7] = ["other"] * len(far[::7])
    rows += [(90_001, "intro " + " ".join(near) + " end", None, None, 0), (90_002, " ".join(far), None, None, 0), (90_003, "never seen words in any of the texts", None, None, 0), (90_004, ("never seen words in any of the texts at all " * 3), None, None, 0)]
    return rows, items


def test_equals_brute_force(spark):
    rows, items = data()
    docs, bench = spark.createDataFrame(rows, brute.SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r)[:3] for r in find_leaks(docs, bench).collect()]
    assert brute.order(got) == brute.order(plain(rows, items))
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns
    bad = {(d, t) for d, t, *_ in rows if plain([(d, t)], items)}
    assert brute.order(kept.collect()) == brute.order([r for r in rows if (r[0], r[1]) not in bad])


def test_documents_a_few_words_short_of_an_item(spark):
    words = [f"w{i}" for i in range(30)]
    rows = [(n, " ".join(words[:n]), None, None, 0) for n in (30, 27, 25, 24, 4)]
    docs, bench = spark.createDataFrame(rows, brute.SCHEMA), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = sorted(tuple(r) for r in find_leaks(docs, bench).collect())
    assert got == [(25, 1, round(21 / 26, 6), 0), (27, 1, round(23 / 26, 6), 0), (30, 1, 1.0, 0)]
    assert sorted(r["doc_id"] for r in decontaminate(docs, bench).collect()) == [4, 24]


def test_whole_table(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows, items = [tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.collect()]
    assert brute.order(tuple(r)[:3] for r in find_leaks(docs, bench).collect()) == brute.order(plain(rows, items))


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], brute.SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(docs, bench).count() == 0
    some = spark.createDataFrame(brute.corpus(1, 10), brute.SCHEMA)
    assert find_leaks(some, bench).count() == 0
    assert decontaminate(some, bench).count() == some.count()


def test_multi_index_misses_nothing_within_the_radius():
    r = np.random.default_rng(2)
    prints = r.integers(0, 2**63, (50, 2), dtype=np.uint64)
    asked = prints[r.integers(0, 50, 200)].copy()
    for p in asked:
        for b in r.choice(128, r.integers(0, 45), replace=False):
            p[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    truth = [np.flatnonzero(np.bitwise_count(prints ^ p).sum(axis=1) <= RADIUS).tolist() for p in asked]
    q, item = MultiIndex(prints).within(asked)
    assert [item[q == i].tolist() for i in range(len(asked))] == truth


def test_few_unrelated_fingerprints_are_candidates():
    r = np.random.default_rng(4)
    index = MultiIndex(r.integers(0, 2**63, (2000, 2), dtype=np.uint64))
    assert len(index.candidates(r.integers(0, 2**63, (100, 2), dtype=np.uint64))[0]) < 0.02 * 100 * 2000


def test_sliding_fingerprints_equal_those_of_each_window():
    r = np.random.default_rng(5)
    of = r.integers(0, 2**63, 700, dtype=np.uint64)
    for n in (1, 7, 100):
        starts = np.unique(r.integers(0, 700 - n, 90))
        alone = [fingerprints(of[s : s + n], np.zeros(1, np.int64), n)[0].tolist() for s in starts]
        assert fingerprints(of, starts, n, 64).tolist() == alone


def test_items_larger_than_a_block_and_other_ids(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 2000)
    long = [f"w{i}" for i in range(1500)]
    items = [("big", " ".join(long)), *[(f"i{k}", " ".join(f"q{k}x{i}" for i in range(40))) for k in range(20)], *[("same", "a b c d e f g h")] * 40, (None, None)]
    rows = [(1.5, "intro " + " ".join(long) + " end", 1, 2), (2.5, " ".join(f"q7x{i}" for i in range(40)), 1, 2), (None, "x a b c d e f g h", 1, 2), (3.5, "clean words only", 1, 2)]
    docs, bench = spark.createDataFrame(rows, "doc_id double, text string, _block int, item_id int"), spark.createDataFrame(items, "item_id string, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in find_leaks(docs, bench).collect())
    assert got == {(1.5, "big"): 1, (2.5, "i7"): 1, (None, "same"): 40}
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [3.5]
