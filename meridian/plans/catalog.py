"""The driver's tables as a catalog, and one query for each operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.catalog import Catalog
from meridian.functions.text import host_of, row_id
from meridian.operators import answers, bookkeeping, browse, edges, graph, hybrid, ingest, keyword, vector
from meridian.session import checkpointed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

DOCUMENT_WEIGHTS = {"name": 5.0, "labels": 1.0, "body": 1.0}
#: Indexes that this process wrote: a folder for each application and state of the documents' files.
_posted: dict[tuple, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def organizations(self) -> DataFrame:
        return self("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))

    def registers(self) -> DataFrame:
        return self("nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("org_id"), F.col("n_name").alias("name"))

    def items(self) -> DataFrame:
        return self("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("register_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("item_class"), F.col("c_acctbal").alias("balance"))

    def part_edges(self) -> DataFrame:
        lines = self("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
        after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("target_id")).distinct()
        return lines.distinct().join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("source_id"), "target_id", F.col("l_returnflag").alias("kind")).distinct()

    def trade_edges(self) -> DataFrame:
        """Customer nation to supplier nation for each return flag, over all orders."""
        return edges.roll_up(self.sold_edges(), self.owners())

    def sold_edges(self) -> DataFrame:
        """Customer to supplier for each return flag."""
        lines = self("lineitem").select("l_orderkey", "l_suppkey", "l_returnflag").join(self("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        return lines.select(F.concat(F.lit("c"), "o_custkey").alias("source_id"), F.concat(F.lit("s"), "l_suppkey").alias("target_id"), F.col("l_returnflag").alias("kind")).distinct()

    def owners(self) -> DataFrame:
        c = self("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_nationkey").alias("register_id"))
        return c.union(self("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_nationkey").alias("register_id")))

    def documents(self) -> DataFrame:
        return self("documents").select(F.col("doc_id").alias("item_id"), "lang", "source", F.substring_index("text", ".", 1).alias("name"), F.concat_ws(" ", "lang", "source").alias("labels"), F.col("text").alias("body"))

    def documents_state(self) -> tuple:
        """The documents' files as they are now: the name, size and time of each."""
        files = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf, state = self.spark.sparkContext._jsc.hadoopConfiguration(), []
        for name in sorted(self("documents").inputFiles()):
            where = files(name)
            status = where.getFileSystem(conf).getFileStatus(where)
            state.append((name, status.getLen(), status.getModificationTime()))
        return self.spark.sparkContext.applicationId, self.sf_dir, tuple(state)

    def posted_documents(self) -> str:
        """The folder of the documents' postings, written once for each state of the files."""
        own = self.documents_state()
        if own not in _posted:
            path = f"{checkpointed(self.spark)}/meridian-postings-{uuid.uuid4().hex}"
            found = keyword.postings(self.documents(), key="item_id", weights=DOCUMENT_WEIGHTS, filters=("lang",))
            keyword.write_postings(found, path, keyword.lengths(self.documents(), key="item_id", weights=DOCUMENT_WEIGHTS), "item_id")
            _posted[own] = path
        return _posted[own]

    def posted(self, *names: str) -> list[DataFrame]:
        path = self.posted_documents()
        schemas = {"postings": "token string, item_id long, field string, positions array<int>, n_tokens long, tf double, first boolean, lang string, slot long, bucket int", "blocks": keyword.BLOCKS, "lengths": keyword.LENGTHS}
        return [self.spark.read.schema(schemas[name]).parquet(f"{path}/{name}") for name in names]

    def chunks(self) -> DataFrame:
        return self("embeddings").select(F.col("vec_id").alias("chunk_key"), (F.col("vec_id") % 100).alias("item_id"), F.concat(F.lit("t"), (F.col("label") % 4).cast("string")).alias("chunk_type"), "label", "embedding")

    def query_vector(self, vec_id: int = 7) -> list[float]:
        row = self("embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
        return [] if row is None else [float(x) for x in row[0]]

    def runs(self) -> DataFrame:
        return self("events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("register_id"), F.col("event_type").alias("status"), F.col("ts").alias("started_at"))


def _pairs(column: str, *fields: str) -> F.Column:
    return F.array_join(F.transform(column, lambda e: F.concat_ws(":", *[e[f].cast("string") for f in fields])), ",")


# browsing


@query("SELECT c_custkey AS id, c_nationkey AS register_id, c_name AS name, c_mktsegment AS item_class, c_acctbal AS balance, count(*) OVER () AS number_matched FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND n_regionkey = 2 ORDER BY id LIMIT 20 OFFSET 20")
def browse_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return browse.browse(t.items(), t.registers(), item_class="BUILDING", org_id=2, limit=20, offset=20)


@query("SELECT c_custkey AS id, c_nationkey AS register_id, c_name AS name, c_mktsegment AS item_class, c_acctbal AS balance, number_matched FROM (SELECT *, count(*) OVER () AS number_matched FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND n_regionkey = 2) WHERE c_custkey > 40 ORDER BY id LIMIT 20")
def browse_seek_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after a cursor, with a count from the kept counts."""
    t = Tables(spark, sf_dir)
    return browse.browse_after(t.items(), t.registers(), browse.filter_counts(t.items(), t.registers()), 40, item_class="BUILDING", org_id=2)


@query("SELECT r_regionkey AS id, r_name AS name FROM region")
def organization_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.list_organizations(Tables(spark, sf_dir).organizations())


@query("SELECT r_regionkey AS id, r_name AS name, string_agg(n_nationkey || ':' || n_name, ',' ORDER BY n_nationkey) AS registers FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey = 2 GROUP BY ALL")
def organization_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return browse.organization_detail(t.organizations(), t.registers(), 2).withColumn("registers", _pairs("registers", "id", "name"))


@query("SELECT n_nationkey AS id, n_regionkey AS org_id, n_name AS name FROM nation WHERE n_regionkey = 3")
def register_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.list_registers(Tables(spark, sf_dir).registers(), 3)


@query("SELECT n_nationkey AS id, n_regionkey AS org_id, n_name AS name, string_agg(c_custkey || ':' || c_name, ',' ORDER BY c_custkey) AS items, count(*) AS n_items FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey = 3 GROUP BY ALL")
def register_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    found = browse.register_detail(t.registers(), t.items(), 3)
    return found.withColumn("n_items", F.size("items").cast("long")).withColumn("items", _pairs("items", "id", "name"))


_EDGES = "e AS (SELECT DISTINCT a.l_partkey AS source_id, b.l_partkey AS target_id, a.l_returnflag AS kind FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"


@query(f"WITH {_EDGES} SELECT p_partkey AS id, p_name AS name, (SELECT string_agg(target_id || ':' || kind, ',' ORDER BY target_id, kind) FROM e WHERE source_id = 7) AS outgoing, (SELECT string_agg(source_id || ':' || kind, ',' ORDER BY source_id, kind) FROM e WHERE target_id = 7) AS incoming FROM part WHERE p_partkey = 7")
def item_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    parts = t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    found = browse.item_detail(parts, t.part_edges(), 7)
    return found.select("id", "name", _pairs("outgoing", "target_id", "kind").alias("outgoing"), _pairs("incoming", "source_id", "kind").alias("incoming"))


@query("WITH a(rank, asked) AS (VALUES (0, 5), (1, 999999999), (2, 3), (3, 17)) SELECT rank::INTEGER AS rank, asked::BIGINT AS asked, c_name AS name, c_custkey IS NOT NULL AS found FROM a LEFT JOIN customer ON c_custkey = asked")
def batch_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.batch_get(Tables(spark, sf_dir).items(), [5, 999999999, 3, 17, 5]).select("rank", "asked", "name", "found")


# edges and graphs


@query(f"WITH {_EDGES} SELECT p_partkey AS id, coalesce(string_agg(target_id || ':' || kind, ',' ORDER BY target_id, kind), '') AS edges FROM part LEFT JOIN e ON source_id = p_partkey WHERE p_size = 1 GROUP BY ALL")
def edges_out_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    ids = t("part").filter("p_size = 1").select(F.col("p_partkey").alias("id"))
    return edges.batched(t.part_edges(), ids).select("id", _pairs("edges", "target_id", "kind").alias("edges"))


@query(f"WITH {_EDGES} SELECT p_partkey AS id, coalesce(string_agg(source_id || ':' || kind, ',' ORDER BY source_id, kind), '') AS edges FROM part LEFT JOIN e ON target_id = p_partkey WHERE p_size = 1 GROUP BY ALL")
def edges_in_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    ids = t("part").filter("p_size = 1").select(F.col("p_partkey").alias("id"))
    return edges.batched(t.part_edges(), ids, "in").select("id", _pairs("edges", "source_id", "kind").alias("edges"))


_TRADE = "r AS (SELECT DISTINCT c_nationkey AS source_register_id, s_nationkey AS target_register_id, l_returnflag AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey)"


@query(f"WITH {_TRADE} SELECT * FROM r")
def register_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).trade_edges()


@query(f"""WITH {_EDGES}, o AS (SELECT source_id AS id, list({{'id': target_id::VARCHAR, 'kind': kind}} ORDER BY target_id::VARCHAR, kind) AS l FROM e GROUP BY 1),
i AS (SELECT target_id AS id, list({{'id': source_id::VARCHAR, 'kind': kind}} ORDER BY source_id::VARCHAR, kind) AS l FROM e GROUP BY 1)
SELECT p_partkey::VARCHAR AS id, to_json({{'id': p_partkey::VARCHAR, 'register_id': (p_partkey % 25)::INTEGER, 'name': CASE WHEN p_partkey % 4 <> 0 THEN p_name END, 'depends_on': coalesce(o.l, []), 'dependents': coalesce(i.l, [])}})::VARCHAR AS answer,
  CASE WHEN p_partkey % 25 % 5 <> 0 THEN 'http://v/' || (p_partkey % 25) || '/bblock/' || p_partkey END AS viewer_link
FROM part LEFT JOIN o ON o.id = p_partkey LEFT JOIN i ON i.id = p_partkey""")
def item_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    key = F.col("p_partkey")
    items = t("part").select(key.cast("string").alias("id"), (key % 25).cast("int").alias("register_id"), F.when(key % 4 != 0, F.col("p_name")).alias("name"))
    slash = F.when(F.col("id") % 2 == 0, "/").otherwise("")
    viewers = t.registers().select(F.col("id").cast("int").alias("id"), F.when(F.col("id") % 5 != 0, F.concat(F.lit("http://v/"), F.col("id").cast("string"), slash)).alias("viewer_url"))
    links = t.part_edges().select(F.col("source_id").cast("string").alias("source_id"), F.col("target_id").cast("string").alias("target_id"), "kind")
    return answers.item_answers(items, links, viewers)


_SOLD = "SELECT DISTINCT 'c' || o_custkey AS source_id, 's' || l_suppkey AS target_id, l_returnflag AS kind, c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"


@query(f"SELECT a AS source_register_id, b AS target_register_id, kind, count(*) AS n FROM ({_SOLD}) WHERE a <> b GROUP BY ALL")
def roll_up_by_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A roll-up of an older state, in which even registers lacked edges and some of their suppliers stood under another one, and what a
    batch of these registers changes in it."""
    t = Tables(spark, sf_dir)
    now, owners = t.sold_edges(), t.owners()
    even = F.col("register_id") % 2 == 0
    older = now.join(owners.filter(even).select(F.col("id").alias("source_id")), "source_id", "left_anti").unionByName(now.filter("kind <> 'R'").join(owners.filter(even).select(F.col("id").alias("source_id")), "source_id", "left_semi"))
    held = owners.withColumn("register_id", F.when(even & F.endswith("id", F.lit("3")), (F.col("register_id") + 2) % 24).otherwise(F.col("register_id")))
    batch = owners.filter(even).select("register_id").union(held.filter(even).select("register_id")).distinct()
    changes = edges.crossing_changes((older, held), (now, owners), batch)
    return edges.with_changes(edges.crossings(older, held), changes)


def _walk_sql(source: str, target: str, depth: int) -> str:
    levels = [f"l1 AS (SELECT DISTINCT {source} AS source, {target} AS target, kind FROM e WHERE {source} = 7)"]
    levels += [f"l{i} AS (SELECT DISTINCT {source} AS source, {target} AS target, kind FROM e WHERE {source} IN (SELECT target FROM l{i - 1}))" for i in range(2, depth + 1)]
    return f"WITH {_EDGES}, {', '.join(levels)} " + " UNION ALL ".join(f"SELECT {i} AS level, * FROM l{i}" for i in range(1, depth + 1))


@query(_walk_sql("source_id", "target_id", 3))
def walk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.walk(Tables(spark, sf_dir).part_edges(), 7, 3)


@query(_walk_sql("target_id", "source_id", 2))
def walk_back_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.walk_back(Tables(spark, sf_dir).part_edges(), 7, 2)


@query(_walk_sql("source_id", "target_id", 3))
def walk_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk over edges that are kept in buckets of their nodes."""
    path = f"{checkpointed(spark)}/meridian-adjacency-{uuid.uuid4().hex}"
    return graph.walk(graph.write_adjacency(Tables(spark, sf_dir).part_edges(), path), 7, 3)


_AROUND = f"{_EDGES}, o1 AS (SELECT * FROM e WHERE source_id = 7), o2 AS (SELECT * FROM e WHERE source_id IN (SELECT target_id FROM o1)), i1 AS (SELECT * FROM e WHERE target_id = 7), i2 AS (SELECT * FROM e WHERE target_id IN (SELECT source_id FROM i1)), g AS (SELECT * FROM o1 UNION SELECT * FROM o2 UNION SELECT * FROM i1 UNION SELECT * FROM i2)"


@query(f"WITH {_AROUND} SELECT source_id AS source, target_id AS target, kind FROM g")
def item_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_edges(Tables(spark, sf_dir).part_edges(), 7, "both", 2)


@query(f"WITH {_AROUND}, n AS (SELECT 7 AS id UNION SELECT source_id FROM g UNION SELECT target_id FROM g) SELECT id, coalesce(p_name, id::VARCHAR) AS name, p_partkey IS NOT NULL AS known FROM n LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) ON p_partkey = id")
def item_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    known = t("part").filter("p_size <= 25").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return graph.graph_nodes(graph.graph_edges(t.part_edges(), 7, "both", 2), 7, known, "bigint")


@query(f"WITH {_TRADE} SELECT source_register_id AS source, target_register_id AS target, kind FROM r WHERE source_register_id = 3 OR target_register_id = 3")
def register_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"source": "source_register_id", "target": "target_register_id"}
    return graph.graph_edges(Tables(spark, sf_dir).trade_edges(), 3, "both", 1, **names)


# search


def _tokens_sql(expr: str) -> str:
    return rf"regexp_replace(strip_accents(lower({expr})), '[^\p{{L}}\p{{N}}]+', '  ', 'g')"


def _bm25_sql(words: list[str], where: str, limit: int) -> str:
    """``item_id, relevance`` of the best documents that have all words."""
    spaced = ", ".join(f"CASE WHEN trim({c}) = '' THEN '' ELSE ' ' || trim({c}) || ' ' END AS {c}" for c in ("a", "b", "c"))
    phrase = [f" {w.replace(' ', '  ')} " for w in words]
    tf = lambda p: " + ".join(f"{w}e0 * ((length({c}) - length(replace({c}, '{p}', ''))) // {len(p)})" for c, w in (("a", 5), ("b", 1), ("c", 1)))
    has = [f"(contains(a, '{p}') OR contains(b, '{p}') OR contains(c, '{p}'))" for p in phrase]
    counts = ", ".join(f"count(*) FILTER (WHERE {h}) AS c{i}" for i, h in enumerate(has))
    idf = lambda i: f"(CASE WHEN ln((n - c{i} + 0.5e0) / (c{i} + 0.5e0)) <= 0 THEN 1e-6 ELSE ln((n - c{i} + 0.5e0) / (c{i} + 0.5e0)) END)"
    score = " + ".join(f"{idf(i)} * ({tf(p)}) * 2.2e0 / (({tf(p)}) + 1.2e0 * (0.25e0 + 0.75e0 * d / m))" for i, p in enumerate(phrase))
    return rf"""
d0 AS (SELECT doc_id AS item_id, lang, source, {_tokens_sql("split_part(text, '.', 1)")} AS a, {_tokens_sql("lang || ' ' || source")} AS b, {_tokens_sql("text")} AS c FROM documents),
d1 AS (SELECT item_id, lang, source, {spaced} FROM d0),
d2 AS (SELECT *, (length(a) - length(replace(a, ' ', ''))) // 2 + (length(b) - length(replace(b, ' ', ''))) // 2 + (length(c) - length(replace(c, ' ', ''))) // 2 AS d FROM d1),
s AS (SELECT count(*) AS n, avg(d) AS m, {counts} FROM d2),
k AS (SELECT item_id, {score} AS relevance FROM d2, s WHERE {" AND ".join(has)} AND {where} ORDER BY relevance DESC, item_id LIMIT {limit})"""


def _keyword(t: Tables, text: str, lang: str | None = "en", limit: int = 50) -> DataFrame:
    filters = None if lang is None else F.col("lang") == lang
    return keyword.search_postings(*t.posted("postings", "lengths"), text, key="item_id", filters=filters, weights=DOCUMENT_WEIGHTS, limit=limit)


def _keyword_once(t: Tables, text: str, lang: str = "en") -> DataFrame:
    """The rows of ``_keyword``, from postings if this process has written them, else from two scans of the tokenised documents: the
    postings of every word take several times the documents' disk, which one search does not pay back."""
    if t.documents_state() in _posted:
        return _keyword(t, text, lang)
    return keyword.search(keyword.index(t.documents(), DOCUMENT_WEIGHTS), text, key="item_id", filters=F.col("lang") == lang, weights=DOCUMENT_WEIGHTS)


@query(f"WITH {_bm25_sql(['of the', 'er', 'and'], "lang = 'en'", 50)} SELECT item_id, round(relevance, 6) AS relevance FROM k")
def keyword_index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search without postings, over tokenised columns."""
    tokens = keyword.index(Tables(spark, sf_dir).documents(), DOCUMENT_WEIGHTS)
    found = keyword.search(tokens, "of-the ER and -", key="item_id", filters=F.col("lang") == "en", weights=DOCUMENT_WEIGHTS)
    return found.select("item_id", F.round("relevance", 6).alias("relevance"))


@query(f"WITH {_bm25_sql(['nder'], "lang = 'en'", 50)} SELECT item_id, round(relevance, 6) AS relevance FROM k")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyword(Tables(spark, sf_dir), "nder").select("item_id", F.round("relevance", 6).alias("relevance"))


@query(f"WITH {_bm25_sql(['of the', 'er', 'and'], "lang = 'en'", 50)} SELECT item_id, round(relevance, 6) AS relevance FROM k")
def keyword_phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyword(Tables(spark, sf_dir), "of-the ER and -").select("item_id", F.round("relevance", 6).alias("relevance"))


@query(rf"SELECT token, count(*) AS n_rows FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all({_tokens_sql("concat_ws(' ', split_part(text, '.', 1), lang, source, text)")}, '[^ ]+')) AS token FROM documents) GROUP BY token")
def document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows have each token, from the index's blocks. The first keyword query to run writes the index."""
    (held,) = Tables(spark, sf_dir).posted("blocks")
    return held.groupBy("token").agg(F.sum("rows").alias("n_rows"))


@query(f"WITH {_bm25_sql(['er', 'and'], "lang = 'en'", 20)} SELECT item_id, round(relevance, 6) AS relevance FROM k")
def keyword_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only slots of rows that can be among the best are read."""
    found = keyword.search_blocks(*Tables(spark, sf_dir).posted("postings", "blocks", "lengths"), "ER and", key="item_id", filters=F.col("lang") == "en", weights=DOCUMENT_WEIGHTS, limit=20)
    return found.select("item_id", F.round("relevance", 6).alias("relevance"))


_NEAR = """q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7),
h AS (SELECT vec_id AS chunk_key, vec_id % 100 AS item_id, 't' || (label % 4) AS chunk_type, list_cosine_distance(embedding::DOUBLE[], q) AS distance FROM embeddings, q WHERE {where} ORDER BY distance, vec_id LIMIT 50)"""


@query(f"WITH {_NEAR.format(where='label < 8')} SELECT chunk_key, item_id, chunk_type, abs(round(distance, 6)) AS distance FROM h")
def nearest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    found = vector.nearest(t.chunks(), t.query_vector(), filters=F.col("label") < 8)
    return found.select("chunk_key", "item_id", "chunk_type", F.abs(F.round("distance", 6)).alias("distance"))


@query(f"WITH {_NEAR.format(where='label < 8')} SELECT chunk_key, item_id, chunk_type, abs(round(distance, 6)) AS distance FROM h")
def nearest_chunks_in_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search, reading cells until no other can hold a nearer chunk."""
    t = Tables(spark, sf_dir)
    kept = vector.write_cells(t.chunks(), f"{checkpointed(spark)}/meridian-cells-{uuid.uuid4().hex}")
    found = vector.nearest_in_cells(kept, t.query_vector(), filters=F.col("label") < 8)
    return found.select("chunk_key", "item_id", "chunk_type", F.abs(F.round("distance", 6)).alias("distance"))


@query(f"WITH {_NEAR.format(where='label % 4 IN (0, 1, 2)')} SELECT item_id, abs(round(min(distance), 6)) AS distance, string_agg(DISTINCT chunk_type, ',' ORDER BY chunk_type) AS matched_chunk_types FROM h GROUP BY item_id")
def best_chunk_per_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    best = vector.best_per_item(vector.nearest(t.chunks(), t.query_vector(), chunk_types=["t0", "t1", "t2"]))
    return best.select("item_id", F.abs(F.round("distance", 6)).alias("distance"), F.array_join("matched_chunk_types", ",").alias("matched_chunk_types"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("item_id", F.round("score", 6).alias("score"), F.array_join("matched_chunk_types", ",").alias("matched_chunk_types"), F.col("rank").cast("long").alias("rank"), "number_matched")


_PAGE = "SELECT item_id, round(score, 6) AS score, matched_chunk_types, row_number() OVER (ORDER BY score DESC, item_id) AS rank, count(*) OVER () AS number_matched FROM f ORDER BY rank LIMIT 20"


@query(f"WITH {_bm25_sql(['nder'], "lang = 'en'", 50)}, {_NEAR.format(where='true')}, b AS (SELECT item_id, min(distance) AS distance, string_agg(DISTINCT chunk_type, ',' ORDER BY chunk_type) AS types FROM h GROUP BY item_id), f AS (SELECT coalesce(k.item_id, b.item_id) AS item_id, 0.75e0 * coalesce(greatest(0e0, 1e0 - distance), 0e0) + 0.25e0 * coalesce(relevance / (1e0 + relevance), 0e0) AS score, coalesce(types, '') AS matched_chunk_types FROM k FULL JOIN b ON k.item_id = b.item_id) {_PAGE}")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    found = hybrid.hybrid_search(_keyword_once(t, "nder"), lambda q: vector.nearest(t.chunks(), q), lambda text: t.query_vector(), "nder")
    return _shown(found)


@query(f"WITH {_bm25_sql(['nder'], "lang = 'en'", 50)}, f AS (SELECT item_id, relevance / (1e0 + relevance) AS score, '' AS matched_chunk_types FROM k) {_PAGE}")
def strict_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return _shown(hybrid.hybrid_search(_keyword_once(t, "nder"), lambda q: vector.nearest(t.chunks(), q), lambda text: [], "nder", strict=True))


@query(f"WITH {_NEAR.format(where='label = 3')}, b AS (SELECT item_id, greatest(0e0, 1e0 - min(distance)) AS score FROM h GROUP BY item_id) SELECT item_id, round(CASE WHEN item_id % 5 = 0 THEN least(1e0, score + 0.1e0) ELSE score END, 6) AS score FROM b")
def boosted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    best = vector.best_per_item(vector.nearest(t.chunks(), t.query_vector(), filters=F.col("label") == 3))
    scored = best.select("item_id", F.greatest(F.lit(0.0), 1 - F.col("distance")).alias("score"))
    matches = spark.range(0, 100, 5).select(F.col("id").alias("item_id"), F.lit(0.5).alias("match"))
    return hybrid.boost_terms(scored, matches).select("item_id", F.round("score", 6).alias("score"))


# bookkeeping


@query("SELECT run_id, register_id, status, started_at FROM (SELECT *, row_number() OVER (PARTITION BY register_id ORDER BY started_at DESC, run_id DESC) AS n FROM (SELECT event_id AS run_id, user_id AS register_id, event_type AS status, ts AS started_at FROM events WHERE user_id IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 1000)) WHERE n = 1")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bookkeeping.latest_run_per_register(Tables(spark, sf_dir).runs())


@query("SELECT event_id AS run_id, user_id AS register_id, event_type AS status, ts AS started_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bookkeeping.recent_runs(Tables(spark, sf_dir).runs())


@query("""
SELECT user_id AS run_id, arg_min(event_id, ts) AS register_id, min(ts) AS started_at, max(CASE WHEN event_type <> 'view' THEN ts END) AS finished_at,
  arg_max(CASE event_type WHEN 'view' THEN 'running' ELSE event_type END, ts) AS status, arg_max(CASE event_type WHEN 'error' THEN props ELSE '' END, ts) AS error
FROM events GROUP BY user_id""")
def folded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    log = Tables(spark, sf_dir)("events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("register_id"), F.col("ts").alias("at"), F.when(kind == "view", "running").otherwise(kind).alias("status"),
        F.when(kind == "error", F.col("props")).otherwise("").alias("error"),
    )
    return bookkeeping.fold_runs(log)


@query("SELECT CASE event_type WHEN 'purchase' THEN 'ready' WHEN 'view' THEN 'crawling' ELSE 'failed' END AS status, count(*) AS n FROM events GROUP BY 1")
def lifecycle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("status") == "purchase", "ok").when(F.col("status") == "view", "running").otherwise("error")
    return Tables(spark, sf_dir).runs().select(bookkeeping.lifecycle(outcome, F.lit(True)).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT DISTINCT l_partkey AS item_id, l_suppkey AS register_id FROM lineitem),
s AS (SELECT l_suppkey AS register_id, min(l_orderkey) AS seq FROM lineitem GROUP BY 1),
o AS (SELECT c.*, first_value(register_id) OVER (PARTITION BY item_id ORDER BY seq, register_id) AS owner FROM c JOIN s USING (register_id))
SELECT item_id AS conflicting_id, owner AS existing_register_id, register_id AS attempted_register_id FROM o WHERE owner <> register_id""")
def identifier_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = Tables(spark, sf_dir)("lineitem")
    raw = lines.select(F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("register_id"), F.struct("l_orderkey", "l_linenumber").alias("position"))
    order = lines.groupBy(F.col("l_suppkey").alias("register_id")).agg(F.min("l_orderkey").alias("crawl_seq"))
    return ingest.conflicts(ingest.claims(raw, order))


@query("""
SELECT l_partkey AS conflicting_id, l_suppkey AS existing_register_id, l_suppkey % 7 AS attempted_register_id,
  min(l_shipdate)::TIMESTAMP AS first_seen, max(l_shipdate)::TIMESTAMP AS last_seen
FROM lineitem WHERE l_partkey < 20 GROUP BY ALL""")
def conflict_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    log = t("lineitem").filter("l_partkey < 20").select(
        F.col("l_partkey").alias("conflicting_id"), F.col("l_suppkey").alias("existing_register_id"), (F.col("l_suppkey") % 7).alias("attempted_register_id"), F.col("l_shipdate").cast("timestamp").alias("detected_at"),
    )
    return Catalog(t.organizations(), t.registers(), t.items(), t.part_edges(), log).conflicts()


@query("""
SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 = 0 OR n_nationkey % 8 = 2 THEN 'ready' WHEN n_nationkey % 4 = 1 THEN 'failed' WHEN n_nationkey % 8 = 6 THEN 'pending' ELSE 'crawling' END AS status,
  CASE n_nationkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' WHEN 2 THEN 'skipped' ELSE 'running' END AS last_crawl_status,
  CASE WHEN n_nationkey % 4 = 1 THEN 'no ' || n_name END AS last_error, CASE WHEN n_nationkey % 4 = 0 THEN 'new' ELSE 'old' END AS modified,
  CASE WHEN n_nationkey % 4 = 0 THEN 2 WHEN n_nationkey % 8 <> 6 THEN 1 END AS indexer_version FROM nation WHERE n_nationkey < 20
UNION ALL SELECT n_nationkey, 'pending', NULL, NULL, 'old', CASE WHEN n_nationkey % 8 <> 6 THEN 1 END FROM nation WHERE n_nationkey >= 20""")
def registers_after_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A skipped register is ready if it was taken in before; every eighth never was."""
    nations = Tables(spark, sf_dir)("nation").select(F.col("n_nationkey").alias("id"), "n_name")
    no_text = F.lit(None).cast("string")
    before = nations.select(
        "id", F.lit("pending").alias("status"), F.lit(None).cast("timestamp").alias("last_crawled_at"), no_text.alias("last_crawl_status"), no_text.alias("last_error"),
        F.lit("old").alias("modified"), F.when(F.col("id") % 8 != 6, 1).alias("indexer_version"),
    )
    kind = F.col("id") % 4
    outcomes = nations.filter("id < 20").select(
        "id", F.when(kind == 0, "ok").when(kind == 1, "error").when(kind == 2, "skipped").otherwise("running").alias("outcome"), F.lit("2024-01-01").cast("timestamp").alias("at"),
        F.when(kind == 1, F.concat(F.lit("no "), "n_name")).alias("error"), F.lit("new").alias("modified"), F.lit(2).alias("indexer_version"),
    )
    return bookkeeping.apply_outcomes(before, outcomes).drop("last_crawled_at")


@query("SELECT 'organization' AS kind, r_regionkey::VARCHAR AS id FROM region WHERE r_regionkey = 4 UNION ALL SELECT 'register', n_nationkey::VARCHAR FROM nation WHERE n_regionkey = 4 OR n_nationkey >= 20")
def orphans_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    tables = {"organizations": t.organizations(), "registers": t.registers(), "items": t.items()}
    return bookkeeping.without_orphans(tables, t.organizations().filter("id <> 4"), t.registers().filter("id < 20"))[1]


@query("SELECT c_nationkey AS register_id, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 4 AND n_nationkey < 20 GROUP BY 1")
def orphan_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    tables = {"organizations": t.organizations(), "registers": t.registers(), "items": t.items()}
    left = bookkeeping.without_orphans(tables, t.organizations().filter("id <> 4"), t.registers().filter("id < 20"))[0]["items"]
    return left.groupBy("register_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS id, (CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END) IS DISTINCT FROM (CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END) OR (CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 2 END) <> 2 AS due FROM orders")
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    due = ingest.needs_reindex(F.when(key % 3 != 0, status), F.when(key % 5 != 0, status), F.when(key % 7 == 0, 1).otherwise(2))
    return Tables(spark, sf_dir)("orders").select(key.alias("id"), due.alias("due"))


@query(r"SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id)::INTEGER AS turn, min(page_id) OVER (PARTITION BY host) AS host_first FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages)")
def host_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = Tables(spark, sf_dir)("pages").select("page_id", "url")
    return bookkeeping.interleaved(pages, host_of(F.col("url")), "page_id").drop("url")


@query("SELECT event_type, sum(CAST(props->>'$.k' AS BIGINT))::BIGINT AS total, count(*) AS n FROM events GROUP BY 1")
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = Tables(spark, sf_dir)("events").select("event_type", F.try_variant_get(ingest.parsed("props"), "$.k", "bigint").alias("k"))
    return events.groupBy("event_type").agg(F.sum("k").alias("total"), F.count("*").alias("n"))


@query("SELECT p_partkey AS id, ('0x' || substr('01234567', (instr('0123456789abcdef', substr(sha1(p_name), 1, 1)) - 1) % 8 + 1, 1) || substr(sha1(p_name), 2, 15))::BIGINT AS row_id FROM part")
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir)("part").select(F.col("p_partkey").alias("id"), row_id(F.col("p_name")).alias("row_id"))


@query("SELECT c_custkey AS id, c_nationkey AS register_id, CASE WHEN c_custkey < 100 THEN 'new ' || c_name ELSE c_name END AS name, c_mktsegment AS item_class, c_acctbal AS balance FROM customer UNION ALL SELECT -1 - r_regionkey, 0, r_name, NULL, NULL FROM region")
def upserted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    changed = t.items().filter("id < 100").select("id", (F.col("register_id") + 1).alias("register_id"), F.concat(F.lit("new "), "name").alias("name"))
    added = t("region").select((-1 - F.col("r_regionkey")).cast("long").alias("id"), F.lit(0).alias("register_id"), F.col("r_name").alias("name"))
    return bookkeeping.upsert(t.items(), changed.unionByName(added), keep=["register_id"])


@query("SELECT id, register_id, name FROM (SELECT c_custkey AS id, c_nationkey AS register_id, c_name AS name FROM customer WHERE c_nationkey NOT IN (3, 4) UNION ALL SELECT s_suppkey, s_nationkey, s_name FROM supplier WHERE s_nationkey IN (3, 4))")
def replaced_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    new = t("supplier").filter("s_nationkey in (3, 4)").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("register_id"), F.col("s_name").alias("name"))
    which = t.registers().filter("id in (3, 4)").select(F.col("id").alias("register_id"))
    return bookkeeping.replace_partition(t.items().select("id", "register_id", "name"), new, "register_id", which)


@query("SELECT s_nationkey AS register_id, count(*) AS n_failed, string_agg(s_suppkey::VARCHAR, ', ' ORDER BY s_suppkey::VARCHAR) AS failed_ids FROM supplier WHERE s_acctbal < 0 GROUP BY 1")
def failure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = Tables(spark, sf_dir)("supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("register_id"), F.col("s_suppkey").cast("string").alias("item_id"))
    return bookkeeping.failure_summary(failed)


@query("SELECT c_custkey AS item_id, s_acctbal AS score, s_suppkey AS rank, c_name AS name FROM supplier JOIN customer ON c_custkey = 3 * s_suppkey")
def hydrated_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    ranked = t("supplier").select((3 * F.col("s_suppkey")).alias("item_id"), F.col("s_acctbal").alias("score"), F.col("s_suppkey").alias("rank"))
    return browse.hydrate(ranked, t.items()).select("item_id", "score", "rank", "name")


@query("SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS text FROM conversations WHERE text IS NOT NULL AND text <> '' GROUP BY conv_id")
def conversation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = Tables(spark, sf_dir)("conversations").filter(F.coalesce("text", F.lit("")) != "")
    lists = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return lists.select("conv_id", "n_turns", F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("text"))


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, len(regexp_extract_all(html, 'href="')) AS n_links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_count("html", F.lit('href="')).cast("long")
    return Tables(spark, sf_dir)("pages").select("page_id", host_of(F.col("url")).alias("host"), links.alias("n_links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


# discovery: the two documents are made from the tables


def _one_object(entries: DataFrame) -> DataFrame:
    """``body``: an object of the few ``k``, ``v``."""
    return entries.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m")).select(F.to_json("m").alias("body"))


@query("""
SELECT 'o' || r_regionkey AS id, CASE WHEN r_regionkey % 2 = 0 THEN r_name ELSE 'o' || r_regionkey END AS name, r_comment AS description,
  'http://o/' || r_regionkey AS url, 'g' || r_regionkey AS github FROM (SELECT *, 'about ' || r_name AS r_comment FROM region)""")
def discovered_organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("r_regionkey")
    facts = F.struct(
        F.when(key % 2 == 0, F.col("r_name")).alias("name"), F.concat(F.lit("about "), "r_name").alias("description"), F.concat(F.lit("http://o/"), key).alias("url"),
        F.array(F.struct(F.concat(F.lit("g"), key).alias("github"))).alias("maintainers"),
    )
    found = ingest.organizations(_one_object(Tables(spark, sf_dir)("region").select(F.concat(F.lit("o"), key).alias("k"), facts.alias("v"))))
    return found.select("id", "name", "description", "url", F.col("maintainers")[0]["github"].alias("github"))


@query("SELECT 'o' || n_regionkey || '/' || n_name || '/x' AS id, 'o' || n_regionkey AS org_id, n_name || '/x' AS name, 'http://r/' || n_nationkey AS register_url FROM nation WHERE n_nationkey % 5 <> 0")
def discovered_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    alias = F.concat(F.when(key % 5 != 0, "@").otherwise(""), F.lit("o"), "n_regionkey", F.lit("/"), "n_name", F.lit("/x"))
    entries = Tables(spark, sf_dir)("nation").select(alias.alias("k"), F.concat(F.lit("http://r/"), key).alias("v"))
    return ingest.registers(_one_object(entries))


# ingestion: register documents are made from the tables and parsed again


def register_documents(t: Tables) -> DataFrame:
    """A register document for every nation: its customers, each linked to the next; identifiers of ten
    customers in a row are claimed by the next nation too."""
    customers = t("customer").select(F.col("c_nationkey").alias("n"), F.col("c_custkey").alias("k"), "c_name", "c_mktsegment")
    claimed = customers.unionByName(customers.filter("k % 100 < 10").withColumn("n", (F.col("n") + 1) % 25))
    item = F.struct(
        F.concat(F.lit("c"), "k").alias("itemIdentifier"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("itemClass"),
        F.array(F.concat(F.lit("bblocks://c"), F.col("k") + 1)).alias("dependsOn"), F.array(F.lit("x"), F.col("c_mktsegment")).alias("tags"),
        F.struct(F.concat(F.lit("http://schema/"), "k").alias("json")).alias("schema"),
    )
    lists = claimed.groupBy("n").agg(F.array_sort(F.collect_list(item)).alias("bblocks"))
    body = F.to_json(F.struct(F.concat(F.lit("register "), "n").alias("name"), F.col("n").cast("string").alias("modified"), "bblocks"))
    return lists.select(F.concat(F.lit("r/"), F.lpad(F.col("n").cast("string"), 2, "0")).alias("id"), F.lit("r").alias("org_id"), F.col("n").cast("string").alias("name"), F.concat(F.lit("http://x/"), "n").alias("register_url"), body.alias("body"))


def _claimed(t: Tables) -> DataFrame:
    fetched = register_documents(t)
    return ingest.claims(ingest.raw_items(fetched), fetched.select(F.col("id").alias("register_id"), F.col("id").alias("crawl_seq")))


_CLAIMS = "c AS (SELECT c_custkey AS k, c_nationkey AS n, c_name, c_mktsegment FROM customer UNION ALL SELECT c_custkey, (c_nationkey + 1) % 25, c_name, c_mktsegment FROM customer WHERE c_custkey % 100 < 10), o AS (SELECT *, min(n) OVER (PARTITION BY k) AS owner FROM c)"


@query(f"WITH {_CLAIMS} SELECT 'c' || k AS id, 'r/' || lpad(n::VARCHAR, 2, '0') AS register_id, c_name AS name, c_mktsegment AS item_class, 'x,' || c_mktsegment AS tags, 'http://schema/' || k AS schema_url, true AS has_schema, false AS has_ld_context FROM o WHERE n = owner")
def ingested_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.items(_claimed(Tables(spark, sf_dir)).filter("accepted"))
    return rows.select("id", "register_id", "name", "item_class", F.array_join("tags", ",").alias("tags"), F.col("schema_urls")["json"].alias("schema_url"), "has_schema", "has_ld_context")


@query(f"WITH {_CLAIMS} SELECT DISTINCT 'c' || k AS source_id, 'c' || (k + 1) AS target_id, 'dependsOn' AS kind FROM o WHERE n = owner")
def ingested_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.edges(_claimed(Tables(spark, sf_dir)).filter("accepted"))


@query(f"WITH {_CLAIMS} SELECT 'c' || k AS conflicting_id, 'r/' || lpad(owner::VARCHAR, 2, '0') AS existing_register_id, 'r/' || lpad(n::VARCHAR, 2, '0') AS attempted_register_id FROM o WHERE n <> owner")
def ingested_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.conflicts(_claimed(Tables(spark, sf_dir)))


# linked documents of customers: full ones for every third, of which each third fails, contexts for every fourth, of
# which every second fails, resolved properties for every fifth


def linked_documents(t: Tables) -> DataFrame:
    """``register_documents`` with links, sources and transforms in the items."""
    docs = register_documents(t).select("*", F.explode(F.expr("from_json(body, 'bblocks array<struct<itemIdentifier string, name string, itemClass string, dependsOn array<string>, tags array<string>>>').bblocks")).alias("i"))
    key = F.substring("i.itemIdentifier", 2, 20).cast("long")
    link = lambda kind: F.concat(F.lit(f"http://{kind}/"), key)
    even = lambda *fields: F.when(key % 2 == 0, F.array(F.struct(*fields)))
    item = F.struct(
        "i.*", F.struct(F.when(key % 3 == 0, F.struct(link("full").alias("url"))).alias("json-full")).alias("documentation"), F.when(key % 4 == 0, link("context")).alias("ldContext"),
        F.when(key % 5 == 0, link("resolved")).alias("resolvedSchemaProperties"), even(F.concat(F.lit("source "), key).alias("title")).alias("sources"),
        even(F.concat(F.lit("turns "), key).alias("description")).alias("transforms"),
    )
    lists = docs.groupBy("id", "org_id", "name", "register_url").agg(F.array_sort(F.collect_list(item)).alias("bblocks"))
    return lists.select("id", "org_id", "name", "register_url", F.to_json(F.struct(F.concat(F.lit("register "), "name").alias("name"), F.col("name").alias("modified"), "bblocks")).alias("body"))


def linked_fetches(t: Tables) -> DataFrame:
    """``url, body, error`` of what the items link to."""
    k = F.col("c_custkey")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    full = text('{"description": "about ', k, '", "examples": [{"title": "T', k, '", "content": "C', k, '", "snippets": [{"language": "ttl", "code": "no"}, {"language": "json", "code": "{', k, '}"}]}]}')
    context = text('{"@context": [{"f": "u:', k, '", "@version": 1.1}, {"g": {"@id": "v:', k, '"}}]}')
    resolved = text('{"properties": [{"path": ["a"]}, {"path": ["a", "p', k, '"]}, {"path": []}]}')
    parts = [("full", 3, 9, full), ("context", 4, 8, context), ("resolved", 5, 1 << 40, resolved)]
    rows = []
    for kind, every, fails, body in parts:
        down = k % fails == 0
        rows.append(t("customer").filter(k % every == 0).select(text(f"http://{kind}/", k).alias("url"), F.when(~down, body).alias("body"), F.when(down, "OSError: down").alias("error")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _chunked(t: Tables) -> tuple[DataFrame, DataFrame]:
    docs = linked_documents(t)
    claimed = ingest.claims(ingest.raw_items(docs), docs.select(F.col("id").alias("register_id"), F.col("id").alias("crawl_seq")))
    return ingest.chunks(docs, claimed.filter("accepted"), linked_fetches(t))


@query(f"""
WITH {_CLAIMS}, a AS (SELECT * FROM o WHERE n = owner AND k % 9 <> 0),
t AS (SELECT k, 'item_core' AS chunk_type, c_name || chr(10) || 'Tags: x, ' || c_mktsegment AS text FROM a
UNION ALL SELECT k, 'item_description', 'about ' || k FROM a WHERE k % 3 = 0
UNION ALL SELECT k, 'item_schema', CASE WHEN k % 4 = 0 AND k % 8 <> 0 THEN 'f: u:' || k || chr(10) || 'g: v:' || k WHEN k % 5 = 0 THEN 'a' || chr(10) || 'a.p' || k END FROM a
UNION ALL SELECT k, 'item_usage', concat_ws(chr(10), CASE WHEN k % 2 = 0 THEN 'Sources: source ' || k || chr(10) || 'Transforms: turns ' || k END,
  CASE WHEN k % 3 = 0 THEN 'T' || k || chr(10) || 'C' || k || chr(10) || '{{' || k || '}}' END) FROM a)
SELECT chunk_type || ':c' || k AS chunk_key, text, chunk_type FROM t WHERE text <> ''
UNION ALL SELECT DISTINCT 'register_summary:http://x/' || n, 'register ' || n, 'register_summary' FROM c""")
def ingested_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(Tables(spark, sf_dir))[0].select("chunk_key", "text", "chunk_type")


@query(f"WITH {_CLAIMS} SELECT 'r/' || lpad(n::VARCHAR, 2, '0') AS register_id, count(*) AS n_failed, string_agg('c' || k, ', ' ORDER BY 'c' || k) AS failed_ids FROM o WHERE n = owner AND k % 9 = 0 GROUP BY n")
def ingested_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bookkeeping.failure_summary(_chunked(Tables(spark, sf_dir))[1])
