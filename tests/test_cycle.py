"""A whole cycle from documents to served results."""

import json

import pytest

from meridian.catalog import Catalog
from meridian.sources.embeddings import KeywordPresence, provider
from meridian.streaming.cycle import Cycle
from meridian.streaming.store import Store

GEO = KeywordPresence(("geo", "feature", "sensor", "unrelated"))


class Web:
    def __init__(self, spark):
        self.spark, self.pages = spark, {}

    def __call__(self, urls):
        rows = [(u, json.dumps(self.pages[u]), None) if u in self.pages else (u, None, "OSError: down") for (u,) in urls.distinct().collect()]
        return self.spark.createDataFrame(rows, "url string, body string, error string")


def _item(name, **more):
    return {"itemIdentifier": name, "name": name, "abstract": f"about {name}", "itemClass": "schema", **more}


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    web = Web(spark)
    web.pages = {
        "index": {"@o/a": "ra", "@o/b": "rb", "@p/c": "rc", "default": "x"}, "orgs": {"o": {"name": "Org"}},
        "ra": {"name": "A", "modified": "1", "abstract": "geo register", "bblocks": [_item("geo.one", dependsOn=["bblocks://sensor.two"], documentation={"json-full": {"url": "full"}}), _item("bad", documentation={"json-full": {"url": "gone"}})]},
        "rb": {"modified": "1", "bblocks": [_item("sensor.two"), _item("geo.one")]}, "full": {"description": "feature of the geo world"},
    }
    cycle = Cycle(Store(str(tmp_path_factory.mktemp("store"))), web, GEO, "index", "orgs")
    return web, cycle


def test_cycle_and_catalog(spark, world):
    web, cycle = world
    first = {r.id: (r.outcome, r.error) for r in cycle.run(spark, 1).collect()}
    assert first["o/a"] == ("error", "failed items: bad") and first["o/b"] == ("ok", None) and first["p/c"][0] == "error"
    second = {r.id: r.outcome for r in cycle.run(spark, 2).collect()}
    assert second == {"o/a": "error", "o/b": "skipped", "p/c": "error"}  # what failed is tried again
    t = cycle.tables(spark)
    assert {r.id: (r.name, r.status) for r in t["registers"].collect()} == {"o/a": ("A", "failed"), "o/b": ("b", "ready"), "p/c": ("c", "failed")}

    served = Catalog(t["organizations"], t["registers"], t["items"], t["edges"].drop("register_id"), cycle.conflicts(spark), cycle.runs(spark), None, t["postings"], t["lengths"], t["chunks"], GEO)

    assert [r.id for r in served.list_items(org="o").collect()] == ["bad", "geo.one", "sensor.two"]
    found = served.search("geo").collect()
    assert [r.item_id for r in found] == ["geo.one", "sensor.two"] and found[0].number_matched == 2 and found[1].score == 0
    assert "item_core" in found[0].matched_chunk_types
    assert served.search("geo", register="none").count() == 0 and served.search("  ", limit=2).count() == 2
    assert [r.item_id for r in served.search("about", strict=True).collect()] == ["bad", "sensor.two", "geo.one"]  # the longer the text, the later
    assert [r.id for r in served.search_registers("geo").collect()] == ["o/a"]
    nodes, links = served.register_graph("o/a", depth=1)
    assert {r.id for r in nodes.collect()} == {"o/a", "o/b"} and [tuple(r) for r in links.collect()] == [("o/a", "o/b", "dependsOn")]
    with pytest.raises(KeyError):
        served.item_graph("none")
    assert served.item_dependencies("sensor.two", direction="dependents").first().edges[0].target == "geo.one"
    assert served.register_dependencies("o/a").count() == 1 and served.item_graph("geo.one")[1].count() == 1
    answer = served.item_answers(["geo.one"]).first()
    assert json.loads(answer.answer)["depends_on"] == [{"id": "sensor.two", "kind": "dependsOn"}] and answer.viewer_link is None and json.loads(answer.answer)["version"] is None
    assert {r.org_id for r in nodes.collect()} == {"o"}
    assert [(r.conflicting_id, r.existing_register_id) for r in served.conflicts().collect()] == [("geo.one", "o/a")]
    assert "status" not in served.list_registers("o").columns and served.item_detail("geo.one").count() == 1
    assert [r.found for r in served.get_items(["bad", "no"]).collect()] == [True, False]
    hits = served.search_tool("geo", limit=99).collect()
    assert [r.id for r in hits] == ["geo.one", "sensor.two"] and all(r.score == round(r.score, 4) for r in hits) and "schema_urls" not in hits[0]
    assert served.search_tool(" ").count() == 3 and [r.id for r in served.list_tool(limit=2).collect()] == ["bad", "geo.one"]
    recent, latest = served.crawl_status()
    runs = {r.run_id: (r.register_id, r.status, r.finished_at is not None) for r in recent.collect()}
    assert runs["cycle-1"] == (None, "ok", True) and runs["1-o/a"] == ("o/a", "error", True) and runs["2-o/b"] == ("o/b", "skipped", True)
    assert {r.register_id for r in latest.collect()} == {"o/a", "o/b", "p/c"}
    assert {r.id: (r.last_crawl_status, r.last_crawled_at is not None) for r in served.register_status().collect()} == {"o/a": ("error", True), "o/b": ("skipped", True), "p/c": ("error", True)}


def test_a_failing_cycle_is_in_the_run_log(spark, tmp_path):
    def down(urls):
        raise OSError("no web")

    cycle = Cycle(Store(str(tmp_path)), down, GEO, "index", "orgs")
    with pytest.raises(OSError):
        cycle.run(spark, 7)
    assert [(r.run_id, r.status, r.error) for r in cycle.runs(spark).collect()] == [("cycle-7", "error", "OSError: no web")]


def test_a_register_left_without_chunks_has_none(spark, tmp_path):
    web = Web(spark)
    web.pages = {"index": {"@o/a": "ra"}, "orgs": {"o": {"name": "Org"}}, "ra": {"name": "A", "modified": "1", "bblocks": [_item("geo.one", dependsOn=["x"])]}}
    cycle = Cycle(Store(str(tmp_path)), web, GEO, "index", "orgs")
    cycle.run(spark, 1)
    assert {n: cycle.tables(spark)[n].count() for n in ("items", "edges", "chunks")} == {"items": 1, "edges": 1, "chunks": 2}
    web.pages["ra"] = {"modified": "2", "bblocks": []}
    web.pages["orgs"] = {"p": {}}
    assert [r.outcome for r in cycle.run(spark, 2).collect()] == ["ok"]
    t = cycle.tables(spark)
    assert [t[n].count() for n in ("items", "edges", "chunks", "postings")] == [0, 0, 0, 0]
    assert [(r.id, r.name) for r in t["organizations"].collect()] == [("p", "p")] and t["registers"].first().modified == "2"


def test_delisted_registers_go_with_all_they_had(spark, world):
    web, cycle = world
    web.pages["index"] = {"@o/a": "ra"}
    web.pages["gone"] = {}
    assert {r.id: r.outcome for r in cycle.run(spark, 3).collect()} == {"o/a": "ok"}
    t = cycle.tables(spark)
    assert {r.id for r in t["registers"].collect()} == {"o/a"} and {r.id for r in t["items"].collect()} == {"geo.one", "bad"}
    assert {r.register_url for r in t["chunks"].select("register_url").distinct().collect()} == {"ra"}


def test_provider_choice():
    assert provider("keywords", keywords=("a",)).documents(["A b"]) == [[1.0]]
    assert provider("self-hosted", url="u", model="m").batch == 32
