"""Browsing, edges, graphs and bookkeeping on small tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from meridian.operators import bookkeeping, browse, edges, graph


@pytest.fixture(scope="module")
def catalog(spark):
    orgs = spark.createDataFrame([("o1", "One"), ("o2", "Two")], "id string, name string")
    registers = spark.createDataFrame([("o1/a", "o1", "a", "ready"), ("o1/b", "o1", "b", "failed"), ("o2/c", "o2", "c", "pending")], "id string, org_id string, name string, status string")
    items = spark.createDataFrame([("i1", "o1/a", "x", "schema", "stable"), ("i2", "o1/a", "y", "model", None), ("i3", "o1/b", "z", "schema", "stable"), ("i4", "o2/c", "w", "schema", None)], "id string, register_id string, name string, item_class string, status string")
    links = spark.createDataFrame([("i1", "i2", "dependsOn"), ("i2", "i3", "dependsOn"), ("i2", "i3", "isProfileOf"), ("i3", "i1", "dependsOn"), ("i1", "gone", "dependsOn")], "source_id string, target_id string, kind string")
    return orgs, registers, items, links


def test_paging_counts_all_matches(catalog):
    _, registers, items, _ = catalog
    rows = browse.browse(items, registers, item_class="schema", limit=2).collect()
    assert [r.id for r in rows] == ["i1", "i3"] and {r.number_matched for r in rows} == {3}
    assert [r.id for r in browse.browse(items, registers, item_class="schema", limit=2, offset=2).collect()] == ["i4"]
    assert [r.id for r in browse.browse(items, registers, org_id="o1", status="stable").collect()] == ["i1", "i3"]


def test_clamps():
    assert browse.clamp(0, 1, 200) == 1 and browse.clamp(999, 1, 200) == 200
    assert browse.page_count(0) == 1 and browse.page_count(41) == 3 and browse.offset_of(3) == 40
    assert graph.clamp_depth(0) == 1 and graph.clamp_depth(9) == 5


def test_details_nest_children_and_edges(catalog):
    orgs, registers, items, links = catalog
    assert [r.id for r in browse.organization_detail(orgs, registers, "o1").first().registers] == ["o1/a", "o1/b"]
    assert [r.id for r in browse.register_detail(registers, items, "o1/a").first().items] == ["i1", "i2"]
    one = browse.item_detail(items, links, "i2").first()
    assert [tuple(e) for e in one.outgoing] == [("i3", "dependsOn"), ("i3", "isProfileOf")] and [tuple(e) for e in one.incoming] == [("i1", "dependsOn")]
    assert browse.item_detail(items, links, "none").count() == 0


def test_status_is_hidden_publicly(catalog):
    assert "status" not in browse.list_registers(catalog[1], hidden=["status"]).columns


def test_batch_get_keeps_order_and_reports_missing(catalog):
    rows = browse.batch_get(catalog[2], ["i3", "nope", "i1", "i3"]).collect()
    assert [(r.asked, r.found) for r in rows] == [("i3", True), ("nope", False), ("i1", True)]


def test_empty_in_list_is_empty(catalog):
    assert browse.where_in(catalog[2], "id", []).count() == 0


def test_batched_edges_and_roll_up(spark, catalog):
    _, _, items, links = catalog
    ids = spark.createDataFrame([("i1",), ("i4",)], "id string")
    got = {r.id: [tuple(e) for e in r.edges] for r in edges.batched(links, ids).collect()}
    assert got == {"i1": [("gone", "dependsOn"), ("i2", "dependsOn")], "i4": []}
    assert edges.incoming(links, "i3").count() == 2 and edges.outgoing(links, "i1").count() == 2
    rolled = {tuple(r) for r in edges.roll_up(links, items).collect()}
    assert rolled == {("o1/a", "o1/b", "dependsOn"), ("o1/a", "o1/b", "isProfileOf"), ("o1/b", "o1/a", "dependsOn")}


def test_replace_outgoing(spark, catalog):
    new = spark.createDataFrame([("i1", "i3", "dependsOn"), ("i1", "i3", "dependsOn")], "source_id string, target_id string, kind string")
    got = edges.replace_outgoing(catalog[3], new.select("source_id").distinct(), new)
    assert {tuple(r) for r in edges.outgoing(got, "i1").collect()} == {("i3", "dependsOn")} and got.count() == 4


def test_graph_keeps_unknown_nodes_and_direction(catalog):
    _, _, items, links = catalog
    found = graph.graph_edges(links, "i1", "both", 1)
    assert {tuple(r) for r in found.collect()} == {("i1", "i2", "dependsOn"), ("i1", "gone", "dependsOn"), ("i3", "i1", "dependsOn")}
    nodes = {r.id: (r.known, r.name) for r in graph.graph_nodes(found, "i1", items.select("id", "name")).collect()}
    assert nodes == {"i1": (True, "x"), "i2": (True, "y"), "i3": (True, "z"), "gone": (False, "gone")}
    alone = graph.graph_edges(links, "i4", "both", 2)
    assert alone.count() == 0 and [r.id for r in graph.graph_nodes(alone, "i4", items.select("id", "name")).collect()] == ["i4"]
    with pytest.raises(ValueError):
        graph.graph_edges(links, "i1", "sideways")


def test_levels_trim_and_repeat_cycles(catalog):
    levels = graph.walk(catalog[3], "i1", 5)
    assert sorted(r.level for r in levels.filter("source = 'i1'").collect()) == [1, 1, 4, 4]
    assert graph.level_lists(graph.walk(catalog[3], "gone", 2)).count() == 0


def test_seek_pages_are_the_offset_pages(spark, catalog, tmp_path):
    orgs, registers, items, _ = catalog
    counts = browse.filter_counts(items, registers)
    for filters in ({}, {"item_class": "schema"}, {"org_id": "o1"}, {"status": "stable", "org_id": "o1"}, {"register_id": "none"}):
        want = [tuple(r) for r in browse.browse(items, registers, limit=100, **filters).select("id", "number_matched").collect()]
        got, after = [], None
        while rows := browse.browse_after(items, registers, counts, after, limit=1, **filters).select("id", "number_matched").collect():
            got.append(tuple(rows[0]))
            after = rows[0]["id"]
        assert got == want
    items.write.parquet(str(tmp_path / "items"))
    plan = browse.browse_after(spark.read.parquet(str(tmp_path / "items")), registers, counts, "i2")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,i2)" in plan


def test_roll_up_by_differences_equals_the_full_one(spark):
    """Random batches that rewrite registers, with items that change hands, come and go."""
    rng = random.Random(2)
    names = [f"i{n}" for n in range(12)]
    owner = {n: rng.choice("abcd") for n in names}
    links = {r: set() for r in "abcd"}
    frames = lambda: (
        spark.createDataFrame([(s, t, k) for r in links for s, t, k in links[r]], "source_id string, target_id string, kind string"),
        spark.createDataFrame(list(owner.items()), "id string, register_id string"),
    )
    before = frames()
    kept = edges.crossings(*before)
    for _ in range(4):
        changed = rng.sample("abcd", rng.randint(1, 2))
        for n in names:
            if owner.get(n) in changed or n not in owner:
                if rng.random() < 0.4:
                    owner.pop(n, None)
                if n not in owner and rng.random() < 0.6:
                    owner[n] = rng.choice(changed)
        for r in "abcd":
            links[r] = {x for x in links[r] if owner.get(x[0]) == r} if r not in changed else {(n, rng.choice(names), rng.choice("kl")) for n in names if owner.get(n) == r for _ in range(3)}
        after = frames()
        batch = spark.createDataFrame([(r,) for r in changed], "register_id string")
        rows = [tuple(r) for r in edges.with_changes(kept, edges.crossing_changes(before, after, batch)).collect()]
        assert sorted(rows) == sorted(tuple(r) for r in edges.crossings(*after).collect())
        assert {r[:3] for r in rows} == {tuple(r) for r in edges.roll_up(*after).collect()}
        kept = spark.createDataFrame(rows, "source_register_id string, target_register_id string, kind string, n long")
        before = after


@pytest.mark.parametrize("bucket_edges", [4_000_000, 20])
def test_adjacency_walks_like_the_edges_and_reads_the_frontiers_buckets(spark, tmp_path, monkeypatch, bucket_edges):
    monkeypatch.setattr(graph, "BUCKET_EDGES", bucket_edges)
    monkeypatch.setattr(graph, "FILE_EDGES", 10)
    rng = random.Random(5)
    rows = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", rng.choice("ab")) for _ in range(150)] + [("n1", f"m{i}", "a") for i in range(60)]
    df = spark.createDataFrame(rows, "source_id string, target_id string, kind string")
    near = graph.write_adjacency(df, str(tmp_path))
    assert near.buckets() == (1 if bucket_edges > 1000 else 16)
    for start in ("n1", "n2", "none"):
        for step in (graph.walk, graph.walk_back):
            assert sorted(map(tuple, step(near, start, 3).collect())) == sorted(map(tuple, step(df, start, 3).collect()))
        assert set(graph.graph_edges(near, start, "both", 2).collect()) == set(graph.graph_edges(df, start, "both", 2).collect())
    frontier = spark.createDataFrame([("n2",), ("n3",)], "source string")
    level = graph.adjacent(near, frontier)
    want = {r[0] for r in frontier.select(graph.bucket_of(F.col("source"), near.buckets())).collect()}
    plan = level._jdf.queryExecution().executedPlan().toString()
    inside = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in inside and all(str(b) in inside for b in want)
    files = [f for f in near.side(False).filter(F.col("bucket").isin(list(want))).inputFiles()]
    assert len(files) == len(near.side(False).inputFiles()) or len(want) < near.buckets()


@pytest.mark.parametrize("kinds", ["source_id long, target_id long, kind string", "source_id int, target_id long, kind string", "source_id long, target_id int, kind string"])
def test_adjacency_finds_numbers_of_other_types_in_their_buckets(spark, tmp_path, monkeypatch, kinds):
    """A start is a Python number, and ends of an edge may differ in type: hashes of the same number then do, too."""
    monkeypatch.setattr(graph, "BUCKET_EDGES", 20)
    rng = random.Random(6)
    df = spark.createDataFrame([(rng.randrange(60), rng.randrange(60), rng.choice("ab")) for _ in range(200)], kinds)
    near = graph.write_adjacency(df, str(tmp_path))
    assert near.buckets() == 16
    for start in (7, 8, 1 << 40):
        for step in (graph.walk, graph.walk_back):
            want = sorted(map(tuple, step(df, start, 3).collect()))
            assert bool(want) == (start < 60)
            assert sorted(map(tuple, step(near, start, 3).collect())) == want


def test_walk_equals_chain_of_joins(spark):
    """The walk against the set of all paths, on random graphs with cycles."""
    rng = random.Random(3)
    for _ in range(3):
        links = {(rng.randrange(8), rng.randrange(8), rng.choice("ab")) for _ in range(16)}
        df = spark.createDataFrame(sorted(links), "source_id long, target_id long, kind string")
        want, frontier = set(), {0}
        for level in range(1, 4):
            step = {(level, *e) for e in links if e[0] in frontier}
            want |= step
            frontier = {e[2] for e in step}
        assert {tuple(r) for r in graph.walk(df, 0, 3).collect()} == want


def test_upsert_updates_inserts_and_keeps(spark):
    now = spark.createDataFrame([(1, "a", "m1"), (2, "b", "m2")], "id int, name string, modified string")
    new = spark.createDataFrame([(2, "B", "zz"), (3, "C", "m3")], "id int, name string, modified string")
    got = {tuple(r) for r in bookkeeping.upsert(now, new, keep=["modified"]).collect()}
    assert got == {(1, "a", "m1"), (2, "B", "m2"), (3, "C", "m3")}


def test_replace_partition(spark):
    now = spark.createDataFrame([("r", 1), ("r", 2), ("s", 3)], "register_id string, id int")
    new = spark.createDataFrame([("r", 9)], "register_id string, id int")
    got = bookkeeping.replace_partition(now, new, "register_id", spark.createDataFrame([("r",)], "register_id string"))
    assert {tuple(r) for r in got.collect()} == {("r", 9), ("s", 3)}


def test_partition_overwrite_leaves_other_registers(spark, tmp_path):
    path = str(tmp_path / "t")
    bookkeeping.write_partitions(spark.createDataFrame([(1, "r"), (2, "s")], "id int, register_id string"), path, "register_id")
    bookkeeping.write_partitions(spark.createDataFrame([(9, "r")], "id int, register_id string"), path, "register_id")
    assert {tuple(r) for r in spark.read.parquet(path).select("id", "register_id").collect()} == {(9, "r"), (2, "s")}


def _at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


def test_latest_run_looks_at_newest_pool(spark):
    runs = spark.createDataFrame([("1", "a", _at(1), "ok"), ("2", "b", _at(2), "ok"), ("3", "b", _at(3), "error"), ("4", None, _at(4), "ok")], "run_id string, register_id string, started_at timestamp, status string")
    assert {(r.register_id, r.run_id) for r in bookkeeping.latest_run_per_register(runs).collect()} == {("a", "1"), ("b", "3")}
    assert {r.register_id for r in bookkeeping.latest_run_per_register(runs, 2).collect()} == {"b"}
    assert [r.run_id for r in bookkeeping.recent_runs(runs, 2).collect()] == ["4", "3"]


def test_fold_runs(spark):
    log = spark.createDataFrame([("1", "a", _at(1), "running", None), ("1", None, _at(5), "error", "boom"), ("2", "b", _at(2), "running", None)], "run_id string, register_id string, at timestamp, status string, error string")
    got = {r.run_id: (r.register_id, r.status, r.error, r.finished_at) for r in bookkeeping.fold_runs(log).collect()}
    assert got == {"1": ("a", "error", "boom", _at(5)), "2": ("b", "running", None, None)}


def test_lifecycle_and_marker(spark):
    registers = spark.createDataFrame([("a", "pending", None, None), ("b", "failed", "old", 2), ("c", "ready", "m", 2)], "id string, status string, modified string, indexer_version int")
    registers = registers.withColumns({"last_crawled_at": F.lit(None).cast("timestamp"), "last_crawl_status": F.lit(None).cast("string"), "last_error": F.lit(None).cast("string")})
    outcomes = spark.createDataFrame([("a", "ok", _at(1), None, "new", 2), ("b", "error", _at(1), "x", "newer", 2), ("c", "skipped", _at(1), None, "m", 2)], "id string, outcome string, at timestamp, error string, modified string, indexer_version int")
    got = {r.id: (r.status, r.modified, r.last_error) for r in bookkeeping.apply_outcomes(registers, outcomes).collect()}
    assert got == {"a": ("ready", "new", None), "b": ("failed", "old", "x"), "c": ("ready", "m", None)}
    again = outcomes.filter("id = 'b'").withColumns({"outcome": F.lit("skipped"), "error": F.lit(None).cast("string"), "modified": F.lit("old")})
    failed = bookkeeping.apply_outcomes(registers, outcomes)
    after = {r.id: (r.status, r.last_crawl_status, r.last_error) for r in bookkeeping.apply_outcomes(failed, again).collect()}
    assert after["b"] == ("ready", "skipped", None)  # what is there is current again
    never = bookkeeping.apply_outcomes(registers.filter("id = 'a'"), again.withColumn("id", F.lit("a")))
    assert never.first().status == "pending"


def test_orphans_cascade(spark, catalog):
    orgs, registers, items, links = catalog
    tables = {"organizations": orgs, "registers": registers, "items": items, "edges": links}
    left, removed = bookkeeping.without_orphans(tables, orgs.filter("id = 'o1'"), registers.filter("id <> 'o1/b'"))
    assert {r.id for r in left["items"].collect()} == {"i1", "i2"}
    assert {tuple(r) for r in removed.collect()} == {("organization", "o2"), ("register", "o1/b"), ("register", "o2/c")}


def test_interleave_is_fair(spark):
    rows = spark.createDataFrame([(0, "h1"), (1, "h1"), (2, "h2"), (3, "h1"), (4, "h3")], "position int, h string")
    assert [r.position for r in bookkeeping.interleaved(rows, F.col("h"), "position").collect()] == [0, 2, 4, 1, 3]


def test_failure_summary(spark):
    df = spark.createDataFrame([("r", "b"), ("r", "a")], "register_id string, item_id string")
    assert tuple(bookkeeping.failure_summary(df).first()) == ("r", 2, "a, b")
