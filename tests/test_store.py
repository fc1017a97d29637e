"""Transactions, replays, compaction and removal in the store."""

import json
import random

import pytest
from pyspark.sql import functions as F

from meridian.schemas import ITEMS
from meridian.streaming.ingest import CONFLICTS, EDGES, LENGTHS, POSTINGS, ingest_batch
from meridian.streaming.store import Conflict, Store, schema_columns


def landed(spark, registers):
    rows = [(i, "o", i, f"http://{i}", json.dumps(b)) for i, b in registers.items()]
    return spark.createDataFrame(rows, "id string, org_id string, name string, register_url string, body string")


def register(modified, *names, links=()):
    return {"modified": modified, "bblocks": [{"itemIdentifier": n, "name": f"name {n}", "dependsOn": list(links)} for n in names]}


def items(spark, store):
    return {(r.id, r.register_id) for r in store.current(spark, "items", ITEMS).collect()}


def opened(df):
    return {f.split("/data/")[1].split("/")[0] for f in df.inputFiles() if "/state/" not in f}


def test_the_same_number_twice_keeps_all_registers(spark, tmp_path):
    store = Store(str(tmp_path / "s"))
    ingest_batch(store, landed(spark, {"r/a": register("1", "x"), "r/b": register("1", "y")}), 0)
    ingest_batch(store, landed(spark, {"r/c": register("1", "z")}), 0)
    assert items(spark, store) == {("x", "r/a"), ("y", "r/b"), ("z", "r/c")}


def test_replays_change_nothing(spark, tmp_path):
    store = Store(str(tmp_path / "s"))
    first = landed(spark, {"r/a": register("1", "x", "w"), "r/b": register("1", "x", "y")})
    assert ingest_batch(store, first, 4, "s1") == 0
    before = items(spark, store)
    log = store.read(spark, "conflicts", CONFLICTS).count()
    assert ingest_batch(store, first, 4, "s1") is None and ingest_batch(store, first, 3, "s1") is None
    assert store.versions(spark) == [0]
    for number, source in ((5, "s1"), (0, "s2"), (4, None), (99, None)):  # the same documents under any other number
        ingest_batch(store, first, number, source)
        assert items(spark, store) == before and store.read(spark, "conflicts", CONFLICTS).count() == log
    assert {(r.id, r.outcome, r.status) for r in store.state(spark).collect()} == {("r/a", "skipped", "ready"), ("r/b", "skipped", "ready")}


def test_of_two_writers_one_fails_and_leaves_nothing(spark, tmp_path):
    store = Store(str(tmp_path / "s"))
    ingest_batch(store, landed(spark, {"r/a": register("1", "x")}), 0)
    one, two = store.begin(spark), store.begin(spark)
    rows = spark.createDataFrame([("l", "e", "a")], "conflicting_id string, existing_register_id string, attempted_register_id string").withColumn("detected_at", F.current_timestamp())
    one.write("conflicts", rows, kind="log")
    two.write("conflicts", rows, kind="log")
    assert one.commit() == 1
    with pytest.raises(Conflict):
        two.commit()
    assert store.read(spark, "conflicts", CONFLICTS).count() == 1 and two.folder.split("/")[1] not in store._names(spark, "data")
    assert [n for n in store._names(spark, "manifest") if not n.endswith(".crc")] == ["000000000000.json", "000000000001.json"]


def test_a_batch_that_fails_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    store = Store(str(tmp_path / "s"))
    ingest_batch(store, landed(spark, {"r/a": register("1", "x")}), 0)
    from meridian.streaming import ingest as module

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(module, "write_search", broken)
    names = store._names(spark, "data")
    with pytest.raises(RuntimeError):
        ingest_batch(store, landed(spark, {"r/a": register("2", "y")}), 1)
    assert items(spark, store) == {("x", "r/a")} and store._names(spark, "data") == names and store.versions(spark) == [0]


def test_after_twenty_batches_a_read_opens_live_files_only(spark, tmp_path):
    """Random batches against a dictionary; a folder whose registers were all written anew is not opened."""
    rng, store, want, marker = random.Random(3), Store(str(tmp_path / "s")), {}, {}
    for batch in range(20):
        changed = {}
        for name in rng.sample("abcdefg", rng.randint(1, 3)):
            marker[name] = marker.get(name, 0) + 1
            want[f"r/{name}"] = [f"{name}{i}" for i in range(rng.randint(0, 3))]
            changed[f"r/{name}"] = register(str(marker[name]), *want[f"r/{name}"], links=["bblocks://t"])
        ingest_batch(store, landed(spark, changed), batch)
        if batch == 11:
            assert store.tidy(spark, most=5) and not store.tidy(spark, most=5)
    expected = {(i, r) for r, ids in want.items() for i in ids}
    assert items(spark, store) == expected
    live = {f"{r.batch:012d}" for r in store.state(spark).select("batch").distinct().collect()}
    for name, schema in (("items", ITEMS), ("edges", EDGES), ("postings", POSTINGS + ", bucket int"), ("lengths", LENGTHS)):
        assert {f.split("-")[0] for f in opened(store.current(spark, name, schema))} <= live, name
    assert len(live) < 9

    version = store.compact(spark)
    rows = store.current(spark, "items", ITEMS)
    assert items(spark, store) == expected and {f.split("-")[0] for f in opened(rows)} == {f"{version:012d}"}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # a folder in which all counts is read as it is
    gone = store.expire(spark, 1)
    assert gone and store._names(spark, "data") == [store.manifest(spark)["state"].split("/")[1]]
    assert items(spark, store) == expected and {(r.source_id, r.register_id) for r in store.current(spark, "edges", EDGES).collect()} == expected
    assert store.read(spark, "conflicts", CONFLICTS).count() == 0 and store.versions(spark) == [version]
    changed = landed(spark, {"r/a": register("new", "fresh")})
    ingest_batch(store, changed, 20)
    assert items(spark, store) == {x for x in expected if x[1] != "r/a"} | {("fresh", "r/a")}


def test_dropped_registers_lose_all_they_had(spark, tmp_path):
    store = Store(str(tmp_path / "s"))
    ingest_batch(store, landed(spark, {"r/a": register("1", "x"), "r/b": register("1", "y", links=["x"])}), 0)
    store.begin(spark).commit(keep=store.state(spark).filter("id = 'r/a'").select("id"))
    assert items(spark, store) == {("x", "r/a")} and store.current(spark, "edges", EDGES).count() == 0
    ingest_batch(store, landed(spark, {"r/b": register("1", "y")}), 1)  # listed again: new, though its marker is the old one
    assert items(spark, store) == {("x", "r/a"), ("y", "r/b")}
    store.begin(spark).commit(keep=store.state(spark).limit(0).select("id"))
    assert items(spark, store) == set() and store.manifest(spark)["tables"]["items"]["folders"] == []
    store.compact(spark)
    assert items(spark, store) == set() and store.expire(spark, 1)


def test_readers_of_an_old_manifest_see_the_old_rows(spark, tmp_path):
    store = Store(str(tmp_path / "s"))
    ingest_batch(store, landed(spark, {"r/a": register("1", "x")}), 0)
    old = store.manifest(spark)
    ingest_batch(store, landed(spark, {"r/a": register("2", "y")}), 1)
    store.compact(spark)
    store.expire(spark, 3)
    assert [r.id for r in store.current(spark, "items", ITEMS, old).collect()] == ["x"] and items(spark, store) == {("y", "r/a")}


def test_error_then_unchanged_is_ready(spark, tmp_path):
    store = Store(str(tmp_path / "s"))
    ingest_batch(store, landed(spark, {"r/a": register("1", "x")}), 0)
    run = store.state(spark).select("id", "run_id", F.lit(None).cast("string").alias("modified"), F.lit(2).alias("indexer_version"), F.lit("error").alias("outcome"), F.lit("down").alias("error"), F.current_timestamp().alias("at"), F.lit(False).alias("replaced"))
    store.begin(spark).commit(run)
    assert [(r.status, r.error, r.stored) for r in store.state(spark).collect()] == [("failed", "down", "1")]
    ingest_batch(store, landed(spark, {"r/a": register("1", "x")}), 1)
    assert [(r.status, r.outcome, r.error) for r in store.state(spark).collect()] == [("ready", "skipped", None)] and items(spark, store) == {("x", "r/a")}


def test_schema_columns():
    assert schema_columns("a string, b map<string,array<struct<x:int,y:int>>>, c int") == ["a string", "b map<string,array<struct<x:int,y:int>>>", "c int"]
