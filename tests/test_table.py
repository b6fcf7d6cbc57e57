"""Tables against a plain model, and the cases in which versions are easily got wrong."""

import random
import time
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest import Expr, SchemaBuilder, Table, declare
from palimpsest.errors import NoSuchField, NullKey, SchemaError, SnapshotExpired, WriteConflict
from palimpsest.operators.table import Backpressure
from palimpsest.plans.compaction import BatchesThreshold, Leveled, Pending, Segment

KV = T.StructType([T.StructField("k", T.StringType(), False), T.StructField("v", T.LongType())])


@pytest.fixture
def table(spark):
    t = Table.in_memory(spark, declare(KV, key="k"))
    yield t
    t.drop()


def put(table, *rows):
    return table.ingest(table.spark.createDataFrame(list(rows), KV).coalesce(1))


def gone(table, *keys):
    return table.delete(table.spark.createDataFrame([(k,) for k in keys], "k string"))


def state(scan):
    return {r.k: r.v for r in scan.collect()}


def test_overwrite_delete_and_snapshots(table):
    put(table, ("a", 10), ("b", 20))
    old = table.begin_snapshot()
    put(table, ("a", 99), ("c", 1), ("c", 2))
    gone(table, "b")
    assert state(table.scan()) == {"a": 99, "c": 2}
    assert state(table.scan(old)) == {"a": 10, "b": 20} == state(table.scan(table.snapshot_at(1)))
    assert state(table.scan(table.snapshot_at(0))) == {}
    table.compact(force=True)
    assert state(table.scan()) == {"a": 99, "c": 2}
    assert state(table.scan(old)) == {"a": 10, "b": 20}
    assert [r.timestamp for r in table.list_versions(2).collect()] == [3, 3]
    assert table.vacuum(1)["segments"] == 3
    assert state(Table.open(table.spark, table.storage.root).scan()) == {"a": 99, "c": 2}
    with pytest.raises(SnapshotExpired):
        table.snapshot_at(1)


def test_stale_versions_stay_hidden(table):
    put(table, ("k", 1))
    put(table, ("k", 5))
    assert state(table.scan().filter(Expr.lt("v", 3))) == {}
    gone(table, "k")
    assert state(table.scan().filter(Expr.gt_eq("v", 0))) == {}


def test_deletes_win_within_a_commit(table):
    rows = table.spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], KV).coalesce(1)
    table.ingest_with_tombstones(rows, F.col("v") == 1)
    assert state(table.scan()) == {"b": 3}


def test_projection_limit_order_and_stream(table):
    put(table, *[(f"k{i:02d}", i) for i in range(20)])
    scan = table.scan().filter(Expr.gt("v", 4)).projection(["v"]).limit(3)
    assert [tuple(r) for r in scan.to_df().collect()] == [(5,), (6,), (7,)]
    assert [len(b) for b in table.scan().stream(8)] == [8, 8, 4]
    batches, profile = table.scan().stream_with_profile()
    assert next(batches)[0].k == "k00" and set(profile) == {"snapshot_ns", "plan_ns", "streams_ns", "merge_ns", "package_ns"} and min(profile.values()) > 0
    assert table.scan().limit(0).collect() == []
    with pytest.raises(NoSuchField):
        table.scan().projection(["x"]).to_df()


def test_segments_are_skipped_and_settled_ones_not_shuffled(table):
    put(table, ("a", 1), ("b", 2))
    put(table, ("x", 3))
    assert len(table.scan().filter(Expr.eq("k", "x")).segments()) == 1
    assert table.scan().filter(Expr.gt("k", "z")).segments() == []
    table.compact(force=True)
    plan = table.scan().to_df()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_rows_are_checked(table):
    with pytest.raises(NullKey):
        table.ingest(table.spark.createDataFrame([(None, 1)], "k string, v long"))
    with pytest.raises(SchemaError):
        table.ingest(table.spark.createDataFrame([("a", "1")], "k string, v string"))
    assert table.log.numbers() == []


def test_transactions(table):
    put(table, ("a", 1), ("b", 2))
    first, second = table.begin_transaction(), table.begin_transaction()
    first.upsert({"k": "a", "v": 7})
    first.delete("b")
    first.delete("c")
    first.upsert(("c", 3))
    assert state(first.scan()) == {"a": 7, "c": 3} and first.get("b") is None and len(first) == 3
    assert state(table.scan()) == {"a": 1, "b": 2}
    second.upsert(("a", 8))
    assert first.commit() == 2
    with pytest.raises(WriteConflict):
        second.commit()
    third = table.begin_transaction()
    third.upsert(("z", 1))
    put(table, ("y", 1))
    assert third.commit() == 4
    empty = table.begin_transaction()
    assert empty.is_empty() and empty.commit() is None
    assert table.get("a") == {"k": "a", "v": 7}


@pytest.mark.parametrize("seed", [1, 13, 57])
def test_random_operations_match_a_model(table, seed):
    rng, model, pinned = random.Random(seed), {}, []
    table.strategy = Leveled(l0_files=3, l0_take=2, level_files=(1, 2), level_take=1, base_file_bytes=1, max_file_bytes=1 << 11)
    for _ in range(30):
        op = rng.choice(["put", "put", "put", "delete", "plan", "plan", "compact", "pin", "reopen", "check"])
        if op == "put":
            rows = [(f"k{rng.randrange(8):02d}", rng.randrange(10_000)) for _ in range(rng.randrange(1, 5))]
            put(table, *rows)
            model |= dict(rows)
        elif op == "delete":
            key = f"k{rng.randrange(8):02d}"
            gone(table, key)
            model.pop(key, None)
        elif op == "compact":
            if rng.random() < 0.3:
                table.compact(force=True)
        elif op == "plan":
            table.compact()
        elif op == "check":
            assert state(table.scan()) == model
            low = f"k{rng.randrange(8):02d}"
            assert state(table.scan().filter(Expr.gt_eq("k", low))) == {k: v for k, v in model.items() if k >= low}
        elif op == "pin":
            pinned.append((table.begin_snapshot(), dict(model)))
        else:
            strategy, table = table.strategy, Table.open(table.spark, table.storage.root, table.config)
            table.strategy = strategy
    assert state(table.scan()) == model
    for snapshot, then in pinned:
        assert state(table.scan(snapshot)) == then


def test_declarations():
    marked = T.StructType([T.StructField("id", T.StringType(), True, {"palimpsest.key": 1}), T.StructField("ts", T.LongType(), True, {"palimpsest.key": 0}), T.StructField("v", T.IntegerType())])
    assert declare(marked).key == ("ts", "id")
    assert declare(KV, metadata={"palimpsest.keys": '["k"]'}).key == declare(KV, indices=[0]).key == ("k",)
    assert SchemaBuilder().column("d", "string").column("t", "long").composite_key("d", "t").build().key == ("d", "t")
    for bad in ({"key": "x"}, {"key": []}, {"indices": [9]}, {}):
        with pytest.raises(SchemaError):
            declare(KV, **bad)
    with pytest.raises(SchemaError):
        declare(T.StructType([T.StructField("a", T.ArrayType(T.LongType()))]), key="a")


def test_planner_and_policies():
    def segment(i, level, low, high):
        return Segment(f"s{i}", level, 1, False, 10, low, high, i, i)

    plan = Leveled().plan([segment(i, 0, i, i + 1) for i in range(8)] + [segment(20, 1, 3, 4), segment(21, 1, 50, 60)])
    assert plan.level == 1 and [s.id for s in plan.inputs] == ["s0", "s1", "s2", "s3", "s4", "s5", "s20"]
    assert Leveled().plan([segment(i, 0, i, i) for i in range(7)]) is None
    assert BatchesThreshold(2).due(Pending(batches=2)) and not BatchesThreshold(2).due(Pending(batches=1))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def small_files(table):
    table.strategy = Leveled(l0_files=2, l0_take=2, base_file_bytes=1 << 12, max_file_bytes=1 << 12)


def many(table, keys, value):
    return table.ingest(table.spark.createDataFrame([(f"k{i:05d}", value + i) for i in keys], KV).repartition(2))


def test_one_more_commit_leaves_the_settled_rows_where_they_are(table):
    many(table, range(4000), 0)
    many(table, range(0, 4000, 2), 10_000)
    small_files(table)
    done = table.compact(force=True)
    assert done["files_out"] > 3
    put(table, ("k00010", 1), ("k00011", 2))
    gone(table, "k00012")
    scan = table.scan()
    plan = plan_of(scan.to_df())
    assert "Exchange hashpartitioning" in plan and "LeftAnti, BuildRight" in plan and "SortMergeJoin" not in plan
    window, rest = plan.split("LeftAnti, BuildRight")[0], plan
    assert rest.count("Exchange hashpartitioning") <= 2 and "Union" in window
    want = {f"k{i:05d}": (10_000 if i % 2 == 0 else 0) + i for i in range(4000)} | {"k00010": 1, "k00011": 2}
    del want["k00012"]
    assert state(table.scan()) == want
    touched = [s for s in table.scan().filter(Expr.eq("k", "k02000")).segments() if s.level]
    assert len(touched) == 1
    assert state(table.scan().filter(Expr.between("k", "k00009", "k00013"))) == {k: v for k, v in want.items() if "k00009" <= k <= "k00013"}
    txn = table.begin_transaction()
    txn.upsert(("k00011", 3))
    txn.delete("k03999")
    assert state(txn.scan()) == {k: v for k, v in (want | {"k00011": 3}).items() if k != "k03999"}


def test_a_merge_rewrites_only_files_that_it_meets(table):
    many(table, range(4000), 0)
    many(table, range(4000), 1)
    small_files(table)
    table.compact(force=True)
    before = {s.id for s in table.log.head().segments}
    put(table, ("k00001", 7))
    put(table, ("k00002", 8))
    done = table.compact()
    after = {s.id for s in table.log.head().segments}
    assert done["level"] == 1 and len(before & after) == len(before) - 1
    assert state(table.scan().filter(Expr.lt("k", "k00003"))) == {"k00000": 1, "k00001": 7, "k00002": 8}
    files = sorted((s.min_key, s.max_key) for s in table.log.head().segments)
    assert all(a[1] < b[0] for a, b in zip(files, files[1:], strict=False))


def test_many_newer_rows_are_resolved_with_one_shuffle(table, monkeypatch):
    monkeypatch.setattr("palimpsest.operators.scan.BROADCAST_ROWS", 10)
    many(table, range(100), 0)
    table.compact(force=True)
    many(table, range(50), 500)
    table.compact(force=True)
    many(table, range(20, 70), 1000)
    gone(table, "k00099")
    assert "LeftAnti" not in plan_of(table.scan().to_df())
    assert state(table.scan()) == {f"k{i:05d}": i + (1000 if 20 <= i < 70 else 500 if i < 50 else 0) for i in range(99)}


def test_deletes_go_at_the_bottom_and_still_conflict(table):
    put(table, ("a", 1), ("b", 2))
    txn = table.begin_transaction()
    gone(table, "a")
    table.compact(force=True)
    assert not any(s.tombstones for s in table.log.head().segments) and table.read(table.log.head().segments).count() == 1
    txn.upsert(("a", 5))
    with pytest.raises(WriteConflict):
        txn.commit()


def test_deletes_stay_above_deeper_versions(table):
    many(table, range(10), 0)
    many(table, range(10), 1)
    table.compact(force=True)
    head, number = table.log.tip()
    deep = tuple(replace(s, level=2) for s in head.segments)
    table.log.append(replace(head, number=number, segments=deep))
    gone(table, "k00003")
    gone(table, "k00004")
    small_files(table)
    assert table.compact()["level"] == 1
    assert {s.level for s in table.log.head().segments} == {1, 2}
    assert sorted(state(table.scan())) == [f"k{i:05d}" for i in range(10) if i not in (3, 4)]


def test_a_torn_head_and_lost_files_do_no_harm(table):
    put(table, ("a", 1))
    torn = table.log.tip()[1]
    with open(f"{table.storage.root.removeprefix('file:')}/_versions/{torn:020d}.json", "w") as f:
        f.write('{"version": 2, "max')
    again = Table.open(table.spark, table.storage.root)
    assert state(again.scan()) == {"a": 1}
    assert put(again, ("b", 2)) == 2 and state(again.scan()) == {"a": 1, "b": 2}
    assert [v.number for v in again.log.newest_first()] == [torn + 1, torn - 1]
    again._write(again.read(again.log.head().segments), 0)  # a writer that dies before it publishes
    assert state(again.scan()) == {"a": 1, "b": 2} and again.vacuum()["orphans"] == 0
    assert again.vacuum(1, orphan_s=-1)["orphans"] >= 2
    assert again.log.numbers() == [torn + 1] and state(again.scan()) == {"a": 1, "b": 2}


def test_one_of_many_writers_gets_a_number(table):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: table.storage.create("_versions/00000000000000000009.json", f'{{"n": {i}}}' * 1000), range(32)))
    assert sum(won) == 1 and table.storage.files("_drafts") == []


def test_concurrent_commits_all_count(table):
    from concurrent.futures import ThreadPoolExecutor

    put(table, ("z", 0))
    with ThreadPoolExecutor(4) as pool:
        stamps = list(pool.map(lambda i: put(Table.open(table.spark, table.storage.root), (f"k{i}", i)), range(4)))
    assert sorted(stamps) == [2, 3, 4, 5] and len(state(table.scan())) == 5


def test_vacuum_by_age(table):
    for i in range(3):
        put(table, ("a", i))
    assert table.vacuum(3)["versions"] == 0
    assert table.vacuum(3, ttl_s=0)["versions"] == 2 and state(table.scan()) == {"a": 2}


def test_worker_and_backpressure(table):
    table.strategy = Leveled(l0_files=3, l0_take=3)
    table.backpressure = Backpressure(slowdown_files=2, stall_files=4)
    for i in range(6):  # without a worker, the commit itself merges
        put(table, ("a", i))
    assert table.metrics["compactions"] >= 1 and state(table.scan()) == {"a": 5}
    assert Backpressure(slowdown_bytes=1).asks(table.log.head().segments[-1:]) == "slow"
    worker = table.start_worker(0.05, pause_s=0.01)
    for i in range(6):
        put(table, (f"b{i}", i))
    end = time.time() + 30
    while sum(s.level == 0 for s in table.log.head().segments) >= 3 and time.time() < end:
        time.sleep(0.05)
    table.stop_worker()
    assert worker.merges >= 1 and worker.error is None and not worker.is_alive()
    assert state(table.scan()) == {"a": 5} | {f"b{i}": i for i in range(6)}


def test_a_late_tombstone_after_many_rows(table):
    many(table, range(6000), 0)
    gone(table, "k05999", "k00000")
    table.compact(force=True)
    assert table.scan().to_df().count() == 5998 and table.get("k05999") is None


def test_old_tombstones_beside_newer_rows_are_seen(table):
    put(table, ("a", 1))
    gone(table, "a")
    put(table, ("b", 1))
    assert state(table.scan(table.snapshot_at(2))) == {} and state(table.scan()) == {"b": 1}


def test_narrow_keys_and_unsigned_values(spark):
    kind = T.StructType([T.StructField("k", T.IntegerType(), False), T.StructField("v", T.DecimalType(20, 0))])
    t = Table.in_memory(spark, declare(kind, key="k"))
    top = Decimal(18446744073709551615)
    t.ingest(spark.createDataFrame([(-5, top), (3, Decimal(1)), (900, Decimal(2))], kind).repartition(3))
    assert [r.k for r in t.scan().filter(Expr.between("k", -(2**40), 2**40)).collect()] == [-5, 3, 900]
    assert [r.k for r in t.scan().filter(Expr.gt("k", 2.5)).collect()] == [3, 900]
    assert [r.k for r in t.scan().filter(Expr.eq("v", 18446744073709551615)).collect()] == [-5]
    t.drop()


def test_nested_values_and_composite_keys(spark):
    kind = T._parse_datatype_string("id long, ts long, company struct<name:string,hq:struct<city:string,zip:int>>, tags array<string>")
    t = Table.in_memory(spark, declare(kind, key=["id", "ts"]))
    a, b = (1, 5, ("x", ("y", None)), ["p", None]), (1, 6, None, None)
    t.ingest(spark.createDataFrame([a, b], kind))
    t.ingest(spark.createDataFrame([(1, 6, ("z", None), [])], kind))
    t.compact(force=True)
    t.ingest(spark.createDataFrame([(2, 0, None, None)], kind))
    assert [(r.id, r.ts, r.company and r.company.name, r.tags) for r in t.scan().collect()] == [(1, 5, "x", ["p", None]), (1, 6, "z", []), (2, 0, None, None)]
    assert t.get(1, 5)["company"] == {"name": "x", "hq": {"city": "y", "zip": None}}
    assert [r.ts for r in t.scan().filter(Expr.is_null("company")).collect()] == [0]
    t.drop()


def test_open_or_create_needs_the_same_definition(table):
    root = table.storage.root
    assert Table.open_or_create(table.spark, root, table.config).config == table.config
    with pytest.raises(SchemaError):
        Table.open_or_create(table.spark, root, declare(T.StructType([T.StructField("k", T.LongType())]), key="k"))
