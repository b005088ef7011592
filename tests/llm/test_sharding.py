import math
import zlib
from collections import Counter

import xxhash

from loomwright.llm.sharding import Node, ShardTree, _group, assign, shard_rows

from . import brute


def place(key, nodes):
    if len(nodes) == 1:
        return nodes[0].shard if nodes[0].shard is not None else place(key, nodes[0].children)

    def draw(n):
        u = ((xxhash.xxh64(f"{key}/{n.name}".encode(), seed=42).intdigest() >> 11) + 0.5) / 2**53
        return -math.log(u) / n.weight

    best = min(nodes, key=draw)
    return best.shard if best.shard is not None else place(key, best.children)


def test_equals_brute_force(spark):
    rows = brute.corpus(4, 80)
    tree = ShardTree.uniform()
    got = shard_rows(spark.createDataFrame(rows, brute.SCHEMA).repartition(3), tree).collect()
    assert len(got) == len(rows)
    want = []
    for i, t, *_ in rows:
        key, b = "null" if i is None else f"k{i}", (t or "").encode()
        want.append((i, len(b) + 1, zlib.crc32(b), "key", place(key, tree.regions), place(key, tree.grow().regions)))
    assert brute.order((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == brute.order(want)
    for shard in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got)


def test_weights_and_movement(spark):
    keys = spark.range(20_000).selectExpr("id AS doc_id")
    rack = lambda r, k, w: _group(f"r{r}/k{k}", [Node(f"r{r}/k{k}/s{i}", x, shard=4 * r + 2 * k + i) for i, x in enumerate(w)])
    old = ShardTree((_group("r0", [rack(0, 0, (1, 1)), rack(0, 1, (1, 1))]), _group("r1", [rack(1, 0, (3, 1)), rack(1, 1, (1, 3))])))
    before = {r["doc_id"]: r["shard"] for r in assign(keys, "doc_id", old).collect()}
    share = Counter(before.values())
    assert abs(share[4] / 20_000 - 3 / 12) < 0.02 and abs(share[0] / 20_000 - 1 / 12) < 0.02
    # within a region weights change hands: nothing moves in or out of it
    new = ShardTree((old.regions[0], _group("r1", [rack(1, 0, (1, 3)), rack(1, 1, (1, 3))])))
    moved = {k: (before[k], r["shard"]) for r in assign(keys, "doc_id", new).collect() if before[k := r["doc_id"]] != r["shard"]}
    assert moved and all(a in (4, 5) and b in (4, 5) for a, b in moved.values())


def test_empty_table_and_clashing_columns(spark):
    assert shard_rows(spark.createDataFrame([], brute.SCHEMA), ShardTree.uniform()).count() == 0
    df = spark.createDataFrame([(1, "a", 5, "z")], "doc_id long, text string, shard int, slot string")
    row = shard_rows(df, ShardTree.uniform(), keep=df.columns).first()
    assert row["slot"] == 0 and row["text"] == "a"


def test_columns_of_the_input_stay(spark):
    docs = spark.createDataFrame([(i, "t", i, i, i, i, i) for i in range(30)], "doc_id long, text string, _h long, _cell long, _rank long, _before long, _n long")
    got = shard_rows(docs, ShardTree.uniform(2, 2, 2), keep=docs.columns).collect()
    assert all(r["_h"] == r["_cell"] == r["_rank"] == r["_before"] == r["_n"] == r["doc_id"] for r in got)
