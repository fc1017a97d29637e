"""A crawl cycle: discover, fetch, take in what changed, index for search, drop what is gone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.operators import bookkeeping, ingest
from meridian.schemas import CHUNKS, INDEXER_VERSION, ITEMS, ORGANIZATIONS, REGISTERS, RUNS
from meridian.sources.embeddings import Provider, embed
from meridian.streaming.ingest import CONFLICTS, EDGES, LENGTHS, POSTINGS, write_search
from meridian.streaming.store import Conflict, Store, Transaction

Fetch = Callable[[DataFrame], DataFrame]
_LISTED = "id string, org_id string, name string, register_url string"
_REGISTERS = _LISTED + ", viewer_url string, description string, register_id string"
_CHUNKS = CHUNKS + ", register_id string, embedding array<float>"
_EVENTS = "run_id string, register_id string, at timestamp, status string, error string"


@dataclass(frozen=True)
class Cycle:
    """``fetch`` gives ``url, body, error`` of a table of URLs, such as ``sources.http.fetch_table``, where hosts take
    turns. The tables it gets name the two root documents, the registers, and what their items link to."""

    store: Store
    fetch: Fetch
    provider: Provider
    index_url: str
    orgs_url: str

    def run(self, spark: SparkSession, batch: int | None = None, only: str | None = None) -> DataFrame:
        """One cycle over all registers, or over ``only`` one. Returns the outcomes ``id, outcome, error``.

        Everything counts at once, when the store's transaction ends. A register whose fetch, items or links
        failed is an error and keeps its old marker; one whose marker has not moved is skipped. A whole cycle
        drops registers that are no longer listed, with all they had. The run log gets a row for the cycle and
        for each register when they start and when they end, a failure included. ``batch`` only names the
        runs; without one they have the store's next number.
        """
        batch = self.store.manifest(spark)["version"] + 1 if batch is None else batch
        self._log(spark, "run_starts", [(f"cycle-{batch}", None, "running", None)])
        held: list[DataFrame] = []

        def keep(df: DataFrame) -> DataFrame:
            held.append(df.persist())
            return held[-1]

        try:
            self._run(spark, batch, only, keep)
        except Exception as e:
            self._log(spark, "run_ends", [(f"cycle-{batch}", None, "error", f"{type(e).__name__}: {e}"[:2000])])
            raise
        finally:
            for df in held:
                df.unpersist()
        self.store.tidy(spark)
        return self.store.state(spark).filter(F.startswith("run_id", F.lit(f"{batch}-"))).select("id", "outcome", "error")

    def _run(self, spark: SparkSession, batch: int, only: str | None, keep: Callable[[DataFrame], DataFrame]) -> None:
        store = self.store
        seen = store.manifest(spark)
        docs = keep(self.fetch(spark.createDataFrame([(self.index_url,), (self.orgs_url,)], "url string")))
        orgs = ingest.organizations(docs.filter(F.col("url") == self.orgs_url))
        listed = keep(ingest.registers(docs.filter(F.col("url") == self.index_url)))
        scope = listed if only is None else listed.filter(F.col("id") == only)
        fetched = keep(scope.join(self.fetch(scope.select(F.col("register_url").alias("url"))).withColumnRenamed("url", "register_url"), "register_url"))
        good = fetched.filter(F.col("body").isNotNull() & ingest.is_object(ingest.parsed("body")))
        good = good.withColumn("modified", ingest.text_at(ingest.parsed("body"), "$.modified"))

        judged = keep(good.join(store.markers(spark, seen), "id", "left").withColumn("due", ingest.needs_reindex(F.col("modified"), F.col("stored"), F.col("version"))))
        due = keep(judged.filter("due").select("id", "org_id", "name", "register_url", "body", "modified"))
        started = due.select(F.concat_ws("-", F.lit(str(batch)), "id").alias("run_id"), F.col("id").alias("register_id"), F.lit("running").alias("status"), F.lit(None).cast("string").alias("error"))
        self._log(spark, "register_starts", [], started)
        tx = store.begin(spark)
        if tx.version != seen["version"] + 2:
            raise Conflict("the store has changed since the registers were judged")
        try:
            self._take_in(tx, batch, only, listed, orgs, fetched, judged, due, keep)
        except BaseException:
            tx.abort()
            raise

    def _take_in(self, tx: Transaction, batch: int, only: str | None, listed: DataFrame, orgs: DataFrame, fetched: DataFrame, judged: DataFrame, due: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> None:
        store, spark = self.store, tx.spark
        order = due.select(F.col("id").alias("register_id"), F.col("id").alias("crawl_seq"))
        # a register that is no longer listed owns nothing
        owners = store.current(spark, "items", ITEMS, tx.base).join(listed.select(F.col("id").alias("register_id")), "register_id", "left_semi").select(F.col("id").alias("item_id"), "register_id")
        claimed = keep(ingest.claims(ingest.raw_items(due), order, owners))
        accepted = claimed.filter("accepted")
        raw = F.col("raw")
        links = F.array_compact(F.array(*[F.nullif(ingest.text_at(raw, p), F.lit("")) for p in ("$.documentation['json-full'].url", "$.ldContext", "$.resolvedSchemaProperties")]))
        chunks, failed = ingest.chunks(due, accepted, keep(self.fetch(accepted.select(F.explode(links).alias("url")).distinct())))
        failed, chunks = keep(failed), keep(chunks)

        items = ingest.items(accepted)
        by_url = due.select("register_url", F.col("id").alias("register_id"))
        source = accepted.select(F.col("item_id").alias("source_id"), "register_id")
        described = chunks.filter("chunk_type = 'item_description'").select(F.col("item_id").alias("id"), F.col("text").alias("description")).dropDuplicates(["id"])
        about = accepted.select(F.col("item_id").alias("id"), F.col("org_id").alias("org")).join(described, "id", "left")
        tx.write("items", items)
        tx.write("edges", ingest.edges(accepted).join(source, "source_id"))
        tx.write("chunks", embed(chunks.join(by_url, "register_url").dropDuplicates(["chunk_key"]), self.provider))
        write_search(tx, items, about)
        tx.write("registers", ingest.register_facts(due).drop("modified").withColumn("register_id", F.col("id")))
        tx.write("conflicts", ingest.conflicts(claimed).withColumn("detected_at", F.current_timestamp()), kind="log")
        if only is None:
            tx.write("organizations", bookkeeping.upsert(store.newest(spark, "organizations", ORGANIZATIONS), orgs).join(orgs.select("id"), "id", "left_semi"), kind="whole")
            tx.write("listed", listed, kind="whole")

        lost = bookkeeping.failure_summary(failed).select(F.col("register_id").alias("id"), F.concat(F.lit("failed items: "), "failed_ids").alias("lost"))
        states = fetched.select("id", F.coalesce("error", F.when(F.col("body").isNull() | ~ingest.is_object(ingest.parsed("body")), "not a JSON object")).alias("broken"))
        states = states.join(judged.select("id", "due", "modified"), "id", "left").join(lost, "id", "left")
        error = F.coalesce("broken", "lost")
        outcome = F.when(error.isNotNull(), "error").when(F.col("due"), "ok").otherwise("skipped")
        done = states.select(
            "id", F.concat_ws("-", F.lit(str(batch)), "id").alias("run_id"), "modified", F.lit(INDEXER_VERSION).alias("indexer_version"), outcome.alias("outcome"),
            error.alias("error"), F.current_timestamp().alias("at"), F.coalesce("due", F.lit(False)).alias("replaced"),
        )
        done = keep(done)
        ended = done.select("run_id", F.col("id").alias("register_id"), F.col("outcome").alias("status"), "error")
        tx.write("run_ends", self._events(spark, [(f"cycle-{batch}", None, "ok", None)], ended), kind="log")
        tx.commit(done, keep=listed if only is None else None)

    @staticmethod
    def _events(spark: SparkSession, rows: list[tuple], more: DataFrame | None = None) -> DataFrame:
        events = spark.createDataFrame(rows, "run_id string, register_id string, status string, error string")
        return (events if more is None else events.unionByName(more)).withColumn("at", F.current_timestamp())

    def _log(self, spark: SparkSession, name: str, rows: list[tuple], more: DataFrame | None = None) -> None:
        tx = self.store.begin(spark)
        tx.write(name, self._events(spark, rows, more), kind="log")
        tx.commit()

    def runs(self, spark: SparkSession) -> DataFrame:
        """The run log as ``meridian.schemas.RUNS``; a run that has not ended is still running."""
        events = [self.store.read(spark, name, _EVENTS).drop("batch") for name in ("run_starts", "register_starts", "run_ends")]
        return bookkeeping.fold_runs(events[0].unionByName(events[1]).unionByName(events[2])).select(*[c.split()[0] for c in RUNS.split(", ")])

    def conflicts(self, spark: SparkSession) -> DataFrame:
        return self.store.read(spark, "conflicts", CONFLICTS).drop("batch")

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The tables as they are served. A register that was listed and never fetched is pending."""
        store = self.store
        schemas = {"items": ITEMS, "edges": EDGES, "chunks": _CHUNKS, "registers": _REGISTERS, "postings": POSTINGS + ", bucket int", "lengths": LENGTHS}
        out = {name: store.current(spark, name, schema) for name, schema in schemas.items()}
        out["organizations"] = store.newest(spark, "organizations", ORGANIZATIONS)
        known = out["registers"].select("id", F.col("name").alias("own_name"), "viewer_url", "description")
        state = store.state(spark).select(
            "id", F.col("stored").alias("modified"), F.col("version").alias("indexer_version"), F.col("status").alias("run_status"), F.col("at").alias("last_crawled_at"),
            F.col("outcome").alias("last_crawl_status"), F.col("error").alias("last_error"),
        )
        rows = store.newest(spark, "listed", _LISTED).join(known, "id", "left").join(state, "id", "left")
        rows = rows.withColumns({"name": F.coalesce("own_name", "name"), "status": F.coalesce("run_status", F.lit("pending"))})
        out["registers"] = rows.select(*[c.split()[0] for c in REGISTERS.split(", ")])
        return out
