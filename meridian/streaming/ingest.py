"""Incremental ingestion of register documents.

Documents land as JSON rows ``id, org_id, name, register_url, body``. A micro-batch skips registers whose
marker has not moved, resolves identifier claims against the stored owners, and writes the rows of each
register anew, in one transaction of the store. So a register that loses all its rows has none, readers
never see half a batch, and a batch that comes again after a failure finds its number taken, or its
registers as they are, and changes nothing.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.operators import ingest, keyword
from meridian.schemas import INDEXER_VERSION, ITEMS
from meridian.streaming.store import Store, Transaction

LANDED = "id string, org_id string, name string, register_url string, body string"
EDGES = "source_id string, target_id string, kind string, register_id string"
CONFLICTS = "conflicting_id string, existing_register_id string, attempted_register_id string, detected_at timestamp"
POSTINGS = "token string, id string, field string, positions array<int>, n_tokens long, tf double, first boolean, slot long, register_id string, org string, item_class string, status string"
LENGTHS = "register_id string, rows long, tokens long"
CRAWL_INTERVAL = 3600.0


def search_rows(items: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths of ``items`` with ``more(id, org, description)``."""
    rows = items.join(more, "id", "left").withColumn("item_identifier", F.col("id"))
    return keyword.postings(rows, filters=("register_id", "org", "item_class", "status")), keyword.lengths(rows, by=("register_id",))


def write_search(tx: Transaction, items: DataFrame, more: DataFrame) -> None:
    """Search rows of a transaction's registers, in place of those they had before."""
    found, sizes = search_rows(items, more)
    tx.write("lengths", sizes)
    total = tx.written_rows("lengths").agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    tx.write("postings", keyword.dealt(found, *total), "bucket", order=("bucket", "token", "slot"))


def ingest_batch(store: Store, landed: DataFrame, batch_id: int, source: str | None = None) -> int | None:
    """Take in ``landed`` and return the store's version, or None where nothing was to be done. Of several documents of one
    register in a batch, the one whose body sorts last counts.

    A batch of a named ``source`` counts once, whatever it holds. Numbers without a source only stand in the
    names of runs: batches are numbered by the store.
    """
    spark = landed.sparkSession
    tx = store.begin(spark)
    if source is not None and tx.base["taken"].get(source, -1) >= batch_id:
        return None
    one = landed.groupBy("id").agg(F.max_by(F.struct("org_id", "name", "register_url", "body"), F.struct("body", "register_url", "name", "org_id")).alias("d")).select("id", "d.*")
    newest = one.withColumn("modified", ingest.text_at(ingest.parsed("body"), "$.modified"))
    judged = newest.join(store.markers(spark, tx.base), "id", "left").withColumn("due", ingest.needs_reindex(F.col("modified"), F.col("stored"), F.col("version")))
    judged = judged.persist()
    claimed = None
    try:
        due = judged.filter("due").select("id", "org_id", "name", "register_url", "body", "modified")
        order = due.select(F.col("id").alias("register_id"), F.col("id").alias("crawl_seq"))
        owners = store.current(spark, "items", ITEMS, tx.base).select(F.col("id").alias("item_id"), "register_id")
        claimed = ingest.claims(ingest.raw_items(due), order, owners).persist()
        accepted = claimed.filter("accepted")
        items = ingest.items(accepted)
        edges = ingest.edges(accepted).join(accepted.select(F.col("item_id").alias("source_id"), "register_id"), "source_id")
        tx.write("conflicts", ingest.conflicts(claimed).withColumn("detected_at", F.current_timestamp()), kind="log")
        tx.write("edges", edges)
        tx.write("items", items)
        write_search(tx, items, accepted.select(F.col("item_id").alias("id"), F.col("org_id").alias("org"), F.lit(None).cast("string").alias("description")))
        outcome = F.when(F.col("due"), "ok").otherwise("skipped")
        done = judged.select(
            "id", F.concat_ws("-", F.lit(str(batch_id)), "id").alias("run_id"), "modified", F.lit(INDEXER_VERSION).alias("indexer_version"), outcome.alias("outcome"),
            F.lit(None).cast("string").alias("error"), F.current_timestamp().alias("at"), F.col("due").alias("replaced"),
        )
        return tx.commit(done, taken=None if source is None else (source, batch_id))
    except BaseException:
        tx.abort()
        raise
    finally:
        judged.unpersist()
        if claimed is not None:
            claimed.unpersist()


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The id that the engine gave to the stream of a checkpoint: a new checkpoint in the same place has another."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]


def run_available(spark: SparkSession, landing: str, store: Store, checkpoint: str) -> None:
    """Take in everything that has landed, compact the store where it has grown, then stop."""
    stream = spark.readStream.schema(LANDED).json(landing)
    taken = lambda df, n: ingest_batch(store, df, n, stream_name(spark, checkpoint)) and None
    query = stream.writeStream.foreachBatch(taken).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    store.tidy(spark)


def run_forever(cycle: Callable[[], None], interval: float = CRAWL_INTERVAL, sleep: Callable[[float], None] = time.sleep, stop: Callable[[], bool] = lambda: False, report: Callable[[Exception], None] = lambda e: None) -> None:
    """Cycles one after another, each ``interval`` seconds after the one before has ended. A failing cycle is reported and the next still comes."""
    while not stop():
        try:
            cycle()
        except Exception as e:  # noqa: BLE001
            report(e)
        sleep(interval)


def edges_of(spark: SparkSession, store: Store) -> DataFrame:
    return store.current(spark, "edges", EDGES)
