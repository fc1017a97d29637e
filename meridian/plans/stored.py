"""Queries over a store: what batches, compaction and orphan removal leave."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.plans.catalog import _CLAIMS, Tables, query, register_documents
from meridian.schemas import ITEMS
from meridian.session import checkpointed
from meridian.sources.chunk_sink import ChunkStore
from meridian.streaming import ownership
from meridian.streaming.ingest import EDGES, ingest_batch
from meridian.streaming.store import Store


def two_batches(spark: SparkSession, sf_dir: str) -> Store:
    """A store of all registers after two batches: in the second, every fifth register is empty, the next ones have new names
    and what the empty ones gave up, and the rest come as they were."""
    store = Store(f"{checkpointed(spark)}/meridian-store-{uuid.uuid4().hex}")
    docs = register_documents(Tables(spark, sf_dir))
    ingest_batch(store, docs, 0)
    number = F.substring("id", 3, 2).cast("int")
    empty = F.to_json(F.struct(F.lit("gone").alias("modified"), F.array().cast("array<string>").alias("bblocks")))
    renamed = F.regexp_replace(F.regexp_replace("body", '"name":"Customer', '"name":"new Customer'), '"modified":"', '"modified":"new ')
    ingest_batch(store, docs.withColumn("body", F.when(number % 5 == 0, empty).when(number % 5 == 1, renamed).otherwise(F.col("body"))), 1)
    return store


def compacted(spark: SparkSession, sf_dir: str) -> Store:
    """The same store, less every fifth register of another remainder, with all that counts in one folder a table."""
    store = two_batches(spark, sf_dir)
    listed = store.state(spark).filter(F.substring("id", 3, 2).cast("int") % 5 != 4).select("id")
    store.begin(spark).commit(keep=listed)
    store.compact(spark)
    store.expire(spark, 1)
    return store


_STORED = f"""{_CLAIMS}, s AS (SELECT k, n, c_name AS name FROM o WHERE n = owner AND n % 5 > 1
UNION ALL SELECT k, n, 'new ' || c_name FROM c WHERE n % 5 = 1)"""
_ROW = "'c' || k AS id, 'r/' || lpad(n::VARCHAR, 2, '0') AS register_id"


@query(f"WITH {_STORED} SELECT {_ROW}, name FROM s")
def stored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_batches(spark, sf_dir).current(spark, "items", ITEMS).select("id", "register_id", "name")


@query(f"WITH {_STORED} SELECT DISTINCT 'c' || k AS source_id, 'c' || (k + 1) AS target_id, 'dependsOn' AS kind, 'r/' || lpad(n::VARCHAR, 2, '0') AS register_id FROM s")
def stored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_batches(spark, sf_dir).current(spark, "edges", EDGES)


@query("""
SELECT 'r/' || lpad(n::VARCHAR, 2, '0') AS id, CASE WHEN n % 5 > 1 THEN 'skipped' ELSE 'ok' END AS outcome, 'ready' AS status,
  CASE n % 5 WHEN 0 THEN 'gone' WHEN 1 THEN 'new ' || n ELSE n::VARCHAR END AS stored, CASE WHEN n % 5 > 1 THEN 0 ELSE 1 END::BIGINT AS batch
FROM (SELECT c_nationkey AS n FROM customer UNION SELECT (c_nationkey + 1) % 25 FROM customer WHERE c_custkey % 100 < 10)""")
def stored_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_batches(spark, sf_dir).state(spark).select("id", "outcome", "status", "stored", "batch")


@query(f"WITH {_STORED} SELECT {_ROW}, name FROM s WHERE n % 5 <> 4")
def compacted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compacted(spark, sf_dir).current(spark, "items", ITEMS).select("id", "register_id", "name")


# ownership: for each of 50 registers a document a month, of what it sold; a document whose marker is the last one's is skipped


def monthly_documents(t: Tables) -> DataFrame:
    month = F.year("o_orderdate").cast("long") * 12 + F.month("o_orderdate")
    lines = t("orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("r"), month.alias("seq")).join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_quantity"), "o_orderkey")
    item = F.when(F.col("l_quantity") > 40, F.concat(F.lit("p"), F.col("l_partkey") % 100))
    docs = lines.groupBy("r", "seq").agg(F.array_sort(F.collect_set(item)).alias("items"))
    return docs.select(F.concat(F.lit("r"), "r").alias("register_id"), "seq", F.concat(F.lit("m"), F.floor(F.col("seq") / 2)).alias("modified"), "items")


_STANDING = """
q AS (SELECT 'r' || (o_custkey % 50) AS register_id, (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS seq, list(DISTINCT 'p' || (l_partkey % 100)) FILTER (WHERE l_quantity > 40) AS items
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
m AS (SELECT *, 'm' || (seq // 2) AS modified FROM q),
b AS (SELECT *, lag(modified) OVER (PARTITION BY register_id ORDER BY seq) AS before FROM m),
d AS (SELECT *, row_number() OVER (PARTITION BY register_id ORDER BY seq) AS n, count(*) OVER (PARTITION BY register_id) AS last FROM b WHERE before IS DISTINCT FROM modified),
e AS (SELECT register_id, seq, n, last, unnest(items) AS item_id FROM d WHERE items IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY register_id, item_id ORDER BY n DESC) AS from_end FROM e),
s AS (SELECT item_id, register_id, min(seq) AS since FROM f WHERE last - n + 1 = from_end GROUP BY ALL),
o AS (SELECT *, first_value(register_id) OVER (PARTITION BY item_id ORDER BY since, register_id) AS owner FROM s)"""


@query(f"WITH {_STANDING} SELECT item_id, register_id, since, owner FROM o")
def standing_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.standing_claims(monthly_documents(Tables(spark, sf_dir)))


@query(f"WITH {_STANDING} SELECT DISTINCT item_id, owner FROM o")
def streamed_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same owners, kept as state of a stream over the documents in the order of their months."""
    where = f"{checkpointed(spark)}/meridian-owners-{uuid.uuid4().hex}"
    monthly_documents(Tables(spark, sf_dir)).repartitionByRange(4, "seq").write.parquet(f"{where}/in")
    docs = spark.readStream.schema(ownership.DOCUMENTS).parquet(f"{where}/in")
    changes = ownership.owner_changes(ownership.register_changes(docs))
    run = changes.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return ownership.current_owners(spark.read.schema(ownership.OWNERS).parquet(f"{where}/out"))


@query("""
WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7),
e AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN list_transform(embedding::DOUBLE[], lambda x: -x) ELSE embedding::DOUBLE[] END AS e FROM embeddings WHERE label <> 3)
SELECT 'v' || vec_id AS chunk_key, abs(round(list_cosine_distance(e, q), 6)) AS distance FROM e, q ORDER BY list_cosine_distance(e, q), chunk_key LIMIT 50""")
def chunk_store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks put in, every tenth put in again with another vector, those of one label taken out, and the nearest of the rest."""
    t = Tables(spark, sf_dir)
    store = ChunkStore(spark, f"{checkpointed(spark)}/meridian-chunks-{uuid.uuid4().hex}", "chunk_key string, label int, embedding array<float>")
    rows = t("embeddings").select("vec_id", F.concat(F.lit("v"), "vec_id").alias("chunk_key"), F.col("label").cast("int").alias("label"), "embedding")
    store.upsert(rows)
    store.upsert(rows.filter("vec_id % 10 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    store.delete_where(F.col("label") == 3)
    return store.search(t.query_vector()).select("chunk_key", F.abs(F.round("distance", 6)).alias("distance"))
