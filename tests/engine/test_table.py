import pytest
from pyspark.sql import functions as F

from loomwright.operators import evolve, maintain, mutate, sampling
from loomwright.operators.namespace import Namespace
from loomwright.operators.scanner import Scanner
from loomwright.sources.table import ROWID, CommitConflict, Table, TableError


@pytest.fixture
def uri(tmp_path):
    return f"file://{tmp_path}/t"


def people(spark, rows):
    return spark.createDataFrame(rows, "name string, age int")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_write_modes_and_versions(spark, uri):
    t = Table.write(people(spark, [("a", 1), ("b", 2)]), uri)
    with pytest.raises(TableError):
        Table.write(people(spark, [("c", 3)]), uri)
    Table.write(people(spark, [("c", 3)]), uri, "append")
    Table.write(people(spark, [("z", 9)]), uri, "overwrite")
    now = Table.open(spark, uri)
    assert [v["rows"] for v in now.versions()] == [2, 3, 1]
    assert now.checkout(2).count_rows() == 3
    assert rows(now.to_df()) == [("z", 9)]
    t.create_tag("one", 1)
    assert Table.open(spark, uri, "one").version == 1
    with pytest.raises(TableError):
        t.create_tag("one", 1)
    Table.open(spark, uri, 2).restore()
    assert Table.open(spark, uri).count_rows() == 3
    Table.open(spark, uri).validate()


def test_merge_insert_rules(spark, uri):
    t = Table.write(people(spark, [("a", 1), ("b", 2), (None, 7)]), uri)
    stats = mutate.MergeInsert(t, "name").when_matched_update_all().execute(people(spark, [("b", 20), ("c", 30), (None, 99)]))
    assert (stats["inserted"], stats["updated"], stats["deleted"]) == (1, 1, 0)
    assert rows(t.to_df()) == sorted([("a", 1), ("b", 20), ("c", 30), (None, 7)], key=repr)
    with pytest.raises(TableError, match="ambiguous"):
        mutate.MergeInsert(t, "name").when_matched_update_all().execute(people(spark, [("a", 5), ("a", 6)]))
    with pytest.raises(TableError):
        mutate.MergeInsert(t, "name").when_matched_fail().execute(people(spark, [("a", 5)]))
    with pytest.raises(TableError):
        mutate.MergeInsert(t, "name").when_not_matched_do_nothing().execute(people(spark, [("a", 5)]))
    mutate.MergeInsert(t, "name").when_not_matched_do_nothing().when_not_matched_by_source_delete().execute(people(spark, [("a", 5)]))
    assert rows(t.to_df()) == sorted([("a", 1), (None, 7)], key=repr)


def test_conflicts(spark, uri):
    Table.write(people(spark, [("a", 1), ("b", 2)]).coalesce(1), uri)
    one, two, three = (Table.open(spark, uri) for _ in range(3))
    mutate.delete(one, "name = 'a'")
    two.append(people(spark, [("c", 3)]))  # commutes with the delete
    assert rows(two.to_df()) == [("b", 2), ("c", 3)]
    with pytest.raises(CommitConflict):
        mutate.update(three, {"age": "0"}, "name = 'b'")  # the same fragment lost rows


def test_scanner_rules(spark, uri):
    df = spark.createDataFrame([(1, "x"), (2, None), (None, "y"), (4, "z")], "i int, s string").coalesce(1)
    t = Table.write(df, uri)
    scan = lambda **k: [r[0] for r in Scanner(t, columns=["i"], **k).to_df().collect()]
    assert scan(order_by=["i"]) == [1, 2, 4, None]
    assert scan(order_by=[("i", True, True)]) == [None, 1, 2, 4]
    assert scan(order_by=[("i", False, False)]) == [4, 2, 1, None]
    assert scan(limit=2, offset=1) == [2, None]
    assert scan(filter='s = "x"') == [1]
    assert Scanner(t, columns={"h": "i / 2"}, filter="i = 1").to_df().collect()[0]["h"] == 0
    for bad in ({"limit": -1}, {"columns": ["i", "i"]}, {"nearest": {}, "full_text": "x"}):
        with pytest.raises(TableError):
            Scanner(t, **bad)
    with pytest.raises(ValueError):
        Scanner(t, filter="s").to_df()
    assert "Scan parquet" in Scanner(t, columns=["i"]).explain()
    said = Scanner(t, columns=["i"], filter="i > 1").analyze()
    assert "rows: 2" in said and "numOutputRows=" in said
    ids = [r[0] for r in t.scan().filter("i = 2 OR i = 4").select(ROWID).collect()]
    for where in (f"_rowid IN ({ids[0]}, {ids[1]})", f"_rowid = {ids[0]} OR _rowid = {ids[1]}", f"i > 1 AND _rowid IN ({ids[0]}, {ids[1]}, 999)"):
        assert sorted(scan(filter=where)) == [2, 4] and "_rowid" in Scanner(t, columns=["i"], filter=where).explain()
    assert [r[0] for r in t.take([3, 0, 0], ["i"]).collect()] == [4, 1, 1]


def test_evolution(spark, uri):
    t = Table.write(people(spark, [("a", 1), ("b", None)]), uri)
    evolve.add_columns(t, {"next": "age + 1"})
    evolve.add_columns(t, {"gap": "cast(null as string)"})
    assert rows(t.to_df()) == sorted([("a", 1, 2, None), ("b", None, None, None)], key=repr)
    evolve.alter_columns(t, {"path": "age", "type": "bigint", "name": "years"})
    assert dict(t.to_df().dtypes)["years"] == "bigint"
    evolve.drop_columns(t, ["next"])
    assert t.to_df().columns == ["name", "years", "gap"]
    for bad in (lambda: evolve.add_columns(t, {"years": "1"}), lambda: evolve.alter_columns(t, {"path": "name", "type": "int"}), lambda: evolve.alter_columns(t, {"path": "years", "nullable": False}), lambda: evolve.drop_columns(t, ["gone"])):
        with pytest.raises(TableError):
            bad()


def test_compaction_and_cleanup(spark, uri):
    t = Table.write(spark.range(100).repartition(4), uri)
    mutate.delete(t, "id < 10")
    ids = rows(t.scan().select("id", ROWID))
    assert maintain.compact(t)["added"] == 1
    assert rows(t.scan().select("id", ROWID)) == ids
    t.create_tag("keep", 1)
    with pytest.raises(TableError):
        maintain.cleanup(t, keep=1)
    assert maintain.cleanup(t, keep=1, ignore_tagged=True)["versions"] == 1
    t.validate()


def test_samplers_deal_every_row_once(spark, uri):
    t = Table.write(spark.range(103).repartition(3), uri)
    dealt = [r[0] for rank in range(3) for r in sampling.sharded_batches(t, 10, rank, 3, seed=4).select("id").collect()]
    assert sorted(dealt) == list(range(103))
    sizes = [sampling.sharded_fixed_batches(t, 10, rank, 3).count() for rank in range(3)]
    assert len(set(sizes)) == 1


def test_namespace(spark, tmp_path):
    ns = Namespace(spark, f"file://{tmp_path}/cat")
    ns.create_namespace("a")
    ns.create_table("a.t", spark.range(3))
    assert ns.list_tables("a") == ["t"] and ns.list_namespaces() == ["a"]
    ns.insert("a.t", spark.range(3, 5))
    assert ns.query("a.t", "SELECT count(*) FROM t").first()[0] == 5
    with pytest.raises(TableError):
        ns.drop_namespace("a")
    ns.drop_table("a.t")
    assert not ns.table_exists("a.t")


def test_regions(spark, uri):
    from loomwright.streaming.ingest import WriteAheadRegions

    log = WriteAheadRegions(Table.write(spark.range(1), uri))
    g = log.advance("r", "me")
    with pytest.raises(TableError):
        log.move("r", g, "you")
    assert [log.move("r", g, "me") for _ in range(3)] == ["sealed", "flushed", "merged"]
    assert log.trim() == 1


def test_deltas_and_system_columns(spark, uri):
    t = Table.write(spark.range(10), uri)
    t.append(spark.range(10, 15))
    mutate.update(t, {"id": "id + 100"}, "id < 3")
    assert rows(t.inserted(1, 2).select("id")) == [(i,) for i in range(10, 15)]
    assert rows(t.updated(2, 3).select("id")) == [(100,), (101,), (102,)]
    assert t.scan().select(F.countDistinct(ROWID)).first()[0] == 15


def test_overtaken_writers_get_ids_of_their_own(spark, uri):
    Table.write(spark.range(10).repartition(2), uri)
    one, two, three = (Table.open(spark, uri) for _ in range(3))
    one.append(spark.range(100, 110).repartition(2))
    two.append(spark.range(200, 210).repartition(2))
    mutate.update(three, {"id": "id + 1000"}, "id < 5")
    now = Table.open(spark, uri)
    now.validate()
    assert now.scan().select(ROWID).distinct().count() == now.count_rows() == 30
    assert mutate.delete(now, "id = 205") == 1
    assert now.scan().count() == now.count_rows() == 29
    assert rows(now.inserted(2, 3).select("id")) == [(i,) for i in range(200, 210) if i != 205]
    assert rows(now.updated(3, 4).select("id")) == [(1000 + i,) for i in range(5)]
    parts = [now.write_uncommitted(spark.range(300, 303)), Table.open(spark, uri).write_uncommitted(spark.range(303, 305))]
    now.append(spark.range(400, 402))
    now.commit_fragments([f for p in parts for f in p])
    now.validate()
    ids = [r[0] for r in now.scan().filter("id IN (101, 203, 304, 1003)").select(ROWID).collect()]
    assert sorted(r[0] for r in now.take_rows(ids, ["id"]).collect()) == [101, 203, 304, 1003]
    before = rows(now.scan().select("id", ROWID, "_row_created_at_version"))
    maintain.compact(now)
    now.validate()
    assert rows(now.scan().select("id", ROWID, "_row_created_at_version")) == before
    addresses = [r[0] for r in Scanner(now, columns=["id"], with_row_address=True).to_df().select("_rowaddr").collect()]
    assert len(set(addresses)) == len(before) and {a >> 32 for a in addresses} <= {f["id"] for f in now.snapshot.fragments}


def test_compaction_of_some_fragments_keeps_the_count(spark, uri):
    t = Table.write(spark.range(1000).repartition(2), uri)
    mutate.delete(t, "id < 3")
    t.append(spark.range(1000, 1010))
    mutate.delete(t, "id >= 1008")
    maintain.compact(t, target_rows=100)
    t.validate()
    assert t.count_rows() == t.scan().count() == 1005
    mutate.delete(t, "id = 1001 OR id = 500")
    t.validate()
    assert t.count_deleted_rows() >= 2 and t.scan(include_deleted=True).count() == 1005 + t.count_deleted_rows() - 2


def test_cleanup_on_a_branch_leaves_main_and_clones(spark, uri, tmp_path):
    t = Table.write(spark.range(20), uri)
    clone = t.shallow_clone(f"file://{tmp_path}/clone")
    b = t.create_branch("b")
    b.overwrite(spark.range(5))
    b.append(spark.range(5, 7))
    for _ in range(2):
        maintain.cleanup(b, keep=1, unverified_after=0)
        maintain.cleanup(Table.open(spark, uri, branch="b"), keep=1, unverified_after=0)
    assert Table.open(spark, uri).scan().count() == 20 and Table.open(spark, uri, branch="b").scan().count() == 7
    t.overwrite(spark.range(2))
    maintain.cleanup(t, keep=1, unverified_after=0)
    assert clone.scan().count() == 20 and Table.open(spark, uri).scan().count() == 2


def test_rewrites_drop_stale_indices(spark, uri):
    from loomwright.operators import indices

    t = Table.write(spark.createDataFrame([(i, i * 2, "s") for i in range(20)], "id int, x int, s string"), uri)
    for c in ("id", "x"):
        indices.create_scalar_index(t, c, "BTREE")
    mutate.update_columns(t, spark.createDataFrame([(3, 777)], "id int, x int"), "id")
    assert [i["column"] for i in indices.describe(t)] == ["id"]
    assert rows(indices.lookup(t, "x", "=", 777).select("id")) == [(3,)] and rows(Scanner(t, columns=["x"], filter="id = 3").to_df()) == [(777,)]
    evolve.alter_columns(t, {"path": "id", "name": "key"})
    assert rows(indices.lookup(t, "key", "=", 5).select("key")) == [(5,)]
    maintain.compact(t)
    assert indices.describe(t)[0]["uncovered"] == 0
    evolve.drop_columns(t, ["key"])
    assert indices.describe(t) == []


def test_a_replayed_batch_is_skipped(spark, uri):
    from loomwright.streaming.ingest import once

    Table.write(people(spark, [("a", 1)]), uri)
    batch = once(uri, "s", lambda t, df, config: t.append(df, config=config))
    for number in (0, 0, 1, 0, 1):
        batch(people(spark, [(f"n{number}", number)]), number)
    assert rows(Table.open(spark, uri).to_df()) == [("a", 1), ("n0", 0), ("n1", 1)]
    assert Table.open(spark, uri).version == 3


def test_inputs_and_column_sizes(spark, uri):
    import pyarrow as pa

    from loomwright.sources.table import as_frame

    one = pa.RecordBatch.from_pydict({"a": [1, 2]})
    for data in (one, pa.Table.from_batches([one]), pa.RecordBatchReader.from_batches(one.schema, [one]), iter([one]), [one], [{"a": 1}, {"a": 2}]):
        assert rows(as_frame(spark, data)) == [(1,), (2,)]
    t = Table.write(spark.range(1000).selectExpr("id", "md5(string(id)) AS m").repartition(3), uri)
    sizes = t.column_bytes()
    assert set(sizes) == {"id", "m"} and sizes["m"] > sizes["id"] > 0


def test_tasks_that_write_several_files_write_one_fragment(spark, uri):
    t = Table.write(spark.range(1000).repartition(2), uri, max_rows_per_file=100)
    assert len({f["id"] for f in t.snapshot.fragments}) == len(t.snapshot.fragments) == 2
    mutate.delete(t, "id % 3 = 0")
    before = t.scan().agg(F.count("id"), F.sum(ROWID)).first()
    maintain.compact(t, target_rows=150)
    t.validate()
    assert t.scan().agg(F.count("id"), F.sum(ROWID)).first() == before and t.count_rows() == 666


def test_offsets_of_rows_in_order_need_no_single_task(spark, uri):
    from loomwright.sources.table import OFFSET

    t = Table.write(spark.range(1000).orderBy("id"), uri)
    t.append(spark.range(1000, 1500).orderBy("id"))
    plan = t.with_offsets()._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    assert t.with_offsets().filter(F.col(OFFSET) != F.col("id")).count() == 0 and t.with_offsets().count() == 1500
    mutate.delete(t, "id % 7 = 0 OR id < 300")
    want = {x: i for i, x in enumerate(x for x in range(300, 1500) if x % 7)}
    assert {r["id"]: r[OFFSET] for r in t.with_offsets().collect()} == want
    maintain.compact(t)
    assert {r["id"]: r[OFFSET] for r in t.with_offsets().collect()} == want
    dealt = [sampling.sharded_batches(t, 16, rank, 3, where="id % 2 = 0").select("id", "_batch").collect() for rank in range(3)]
    order = sorted(x for x in want if x % 2 == 0)
    assert {r["id"]: r["_batch"] for part in dealt for r in part} == {x: i // 16 for i, x in enumerate(order)}


def test_ordered_tables_are_not_sorted_by_one_task(spark, sf):
    import inspect

    from loomwright.plans import engineq

    for name in ("zone_stats", "sharded_batches_in_order", "fts_with_filter", "take_offsets"):
        assert "coalesce(1)" not in inspect.getsource(getattr(engineq, name)), name
    ranks = engineq.sharded_batches_in_order(spark, sf).collect()
    keys = sorted(r["o_orderkey"] for r in ranks)
    assert {r["o_orderkey"]: r["rank"] for r in ranks} == {k: i // 16 % 3 for i, k in enumerate(keys)}
