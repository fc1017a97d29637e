"""The catalog as a set of tables, and the functions that serve it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions.text import org_of_register
from meridian.operators import answers, bookkeeping, browse, edges, graph, hybrid, keyword, vector
from meridian.sources.embeddings import Provider

_PUBLIC_HIDES = ("status", "last_crawled_at", "last_crawl_status", "last_error", "modified", "indexer_version")


@dataclass
class Catalog:
    """Tables as in ``meridian.schemas``.

    ``postings`` and ``lengths`` are what ``keyword.postings`` and ``keyword.lengths`` made of the items with
    their filter columns ``org``, ``register_id``, ``item_class`` and ``status``; ``indexed``, what
    ``keyword.index`` made of them, serves where there are no postings. ``chunks`` has embeddings and the
    same filters.
    """

    organizations: DataFrame
    registers: DataFrame
    items: DataFrame
    item_edges: DataFrame
    conflicts_log: DataFrame | None = None
    runs: DataFrame | None = None
    indexed: DataFrame | None = None
    postings: DataFrame | None = None
    lengths: DataFrame | None = None
    chunks: DataFrame | None = None
    provider: Provider | None = None
    keyword_candidates: int = keyword.CANDIDATES
    semantic_candidates: int = vector.CANDIDATES
    semantic_weight: float = field(default=hybrid.SEMANTIC_WEIGHT)

    # listings and details

    def list_orgs(self) -> DataFrame:
        return browse.list_organizations(self.organizations)

    def org_detail(self, org_id: str) -> DataFrame:
        return browse.organization_detail(self.organizations, self.registers, org_id)

    def list_registers(self, org: str | None = None) -> DataFrame:
        return browse.list_registers(self.registers, org, _PUBLIC_HIDES)

    def register_detail(self, register_id: str) -> DataFrame:
        return browse.register_detail(self.registers.drop(*_PUBLIC_HIDES), self.items, register_id)

    def register_by_url(self, url: str) -> DataFrame:
        return browse.by_id(self.registers, url, "register_url")

    def item_detail(self, item_id: str) -> DataFrame:
        return browse.item_detail(self.items, self.item_edges, item_id)

    def get_items(self, ids: Sequence[str]) -> DataFrame:
        return browse.batch_get(self.items, ids)

    def list_items(self, *, item_class: str | None = None, status: str | None = None, register: str | None = None, org: str | None = None, limit: int = browse.PAGE, offset: int = 0) -> DataFrame:
        return browse.browse(self.items, self.registers, limit=limit, offset=offset, item_class=item_class, status=status, register_id=register, org_id=org)

    # graphs

    def register_edges(self) -> DataFrame:
        return edges.roll_up(self.item_edges, self.items.select("id", "register_id"))

    def item_answers(self, ids: Sequence[str]) -> DataFrame:
        """``id, answer, viewer_link`` of the items asked for, the answer as JSON."""
        return answers.item_answers(browse.where_in(self.items, "id", list(ids)), self.item_edges, self.registers)

    def item_graph(self, item_id: str, direction: str = "both", depth: int = graph.DEPTH_REST) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges. An unknown start is an error: asking for it is a point lookup."""
        self._known(self.items, item_id)
        found = graph.graph_edges(self.item_edges, item_id, direction, depth)
        about = self.items.select("id", "name", "item_class", "register_id")
        return graph.graph_nodes(found, item_id, about), found

    @staticmethod
    def _known(nodes: DataFrame, key: str) -> None:
        if browse.by_id(nodes, key).select("id").isEmpty():
            raise KeyError(f"{key!r} is not there")

    def register_graph(self, register_id: str, direction: str = "both", depth: int = graph.DEPTH_REST) -> tuple[DataFrame, DataFrame]:
        self._known(self.registers, register_id)
        found = graph.graph_edges(self.register_edges(), register_id, direction, depth, source="source_register_id", target="target_register_id")
        nodes = graph.graph_nodes(found, register_id, self.registers.select("id", "name", "org_id"))
        return nodes.withColumn("org_id", F.coalesce("org_id", org_of_register(F.col("id")))), found  # an unknown register's id says whose it is

    def item_dependencies(self, item_id: str, depth: int = graph.DEPTH_TOOL, direction: str = "depends_on") -> DataFrame:
        """Levels as the walk finds them; against the edges, the source is the item walked from."""
        step = graph.walk if direction == "depends_on" else graph.walk_back
        return graph.level_lists(step(self.item_edges, item_id, depth))

    def register_dependencies(self, register_id: str, depth: int = graph.DEPTH_TOOL, direction: str = "depends_on") -> DataFrame:
        step = graph.walk if direction == "depends_on" else graph.walk_back
        return graph.level_lists(step(self.register_edges(), register_id, depth, source="source_register_id", target="target_register_id"))

    # search

    @staticmethod
    def _filters(register_column: str, register: str | None, org: str | None, item_class: str | None, status: str | None) -> Column | None:
        out = None
        for name, value in ((register_column, register), ("org", org), ("item_class", item_class), ("status", status)):
            if value is not None:
                one = F.col(name) == F.lit(value)
                out = one if out is None else out & one
        return out

    def _words(self, query: str, filters: Column | None) -> DataFrame:
        if self.postings is not None:
            return keyword.search_postings(self.postings, self.lengths, query, filters=filters, limit=self.keyword_candidates)
        return keyword.search(self.indexed, query, filters=filters, limit=self.keyword_candidates)

    def search(self, query: str, *, item_class: str | None = None, status: str | None = None, register: str | None = None, org: str | None = None, limit: int = browse.PAGE, offset: int = 0, strict: bool = False) -> DataFrame:
        """Hybrid search; a query without a word browses. ``number_matched`` counts items that exist.

        An unknown register gives nothing: both passes filter by it.
        """
        limit = browse.clamp(limit, 1, browse.MOST_REST)
        if not query.strip():
            return self.list_items(item_class=item_class, status=status, register=register, org=org, limit=limit, offset=offset)
        existing = self.items.select(F.col("id").alias("item_id"))
        words = self._words(query, self._filters("register_id", register, org, item_class, status))
        words = words.withColumnRenamed("id", "item_id").join(existing, "item_id", "left_semi")
        near = self._filters("register_id", register, org, item_class, status)
        ready = self.chunks is not None and self.provider is not None

        def neighbours(q: Sequence[float]) -> DataFrame:
            hits = vector.nearest(self.chunks, q, limit=self.semantic_candidates, filters=near, chunk_types=vector.ITEM_CHUNKS)
            return hits.join(existing, "item_id", "left_semi")

        embed = self.provider.query if ready else lambda text: []
        found = hybrid.hybrid_search(words, neighbours, embed, query, strict=strict or not ready, weight=self.semantic_weight, limit=limit, offset=offset)
        return browse.hydrate(found, self.items.drop("score", "rank", "number_matched"), "item_id")

    # the tools: tighter limits, summaries, scores as people read them

    def search_tool(self, query: str, *, limit: int = 10, **filters: str | None) -> DataFrame:
        """At most 50 hits with the columns of a listed item, ``matched_chunk_types`` and the score to four digits, best first."""
        found = self.search(query, limit=browse.clamp(limit, 1, browse.MOST_SEARCH_TOOL), **filters)
        if "rank" not in found.columns:  # a query without a word browses
            return browse.summary(found)
        shown = found.withColumnRenamed("item_id", "id").withColumn("score", F.round("score", 4))
        return browse.summary(shown, "matched_chunk_types", "score", "rank").orderBy("rank")

    def list_tool(self, *, limit: int = browse.PAGE, offset: int = 0, **filters: str | None) -> DataFrame:
        found = self.list_items(limit=browse.clamp(limit, 1, browse.MOST_LIST_TOOL), offset=offset, **filters)
        return browse.summary(found, "number_matched").orderBy("id")

    def search_registers(self, query: str, limit: int = browse.PAGE) -> DataFrame:
        """Registers by the nearest summary."""
        hits = vector.nearest(self.chunks, self.provider.query(query), limit=limit, chunk_types=vector.REGISTER_CHUNKS)
        return hits.select("register_url", F.greatest(F.lit(0.0), 1 - F.col("distance")).alias("score")).join(self.registers.drop(*_PUBLIC_HIDES), "register_url").orderBy(F.desc("score"), "id")

    # administration

    def crawl_status(self) -> tuple[DataFrame, DataFrame]:
        """Recent runs, and the latest run of each register."""
        return bookkeeping.recent_runs(self.runs), bookkeeping.latest_run_per_register(self.runs)

    def register_status(self) -> DataFrame:
        return self.registers.select("id", "status", "last_crawled_at", "last_crawl_status", "last_error").orderBy("id")

    def conflicts(self) -> DataFrame:
        """Every conflict once, with when it was first and last seen, newest first."""
        keys = ["conflicting_id", "existing_register_id", "attempted_register_id"]
        return self.conflicts_log.groupBy(*keys).agg(F.min("detected_at").alias("first_seen"), F.max("detected_at").alias("last_seen")).orderBy(F.desc("last_seen"), *keys)
