"""Run logs, lifecycles, upserts, replacement and orphans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECENT, LATEST_POOL = 50, 1000


def upsert(current: DataFrame, new: DataFrame, keys: Sequence[str] = ("id",), keep: Sequence[str] = ()) -> DataFrame:
    """``current`` with the rows of ``new`` put in by key; columns in ``keep`` never change on an update.

    ``new`` has distinct keys. Its missing columns are null in inserted rows.
    """
    keys = list(keys)
    fresh = new.select(*keys, *[(F.col(c) if c in new.columns else F.lit(None).cast(t)).alias(f"__n_{c}") for c, t in current.dtypes if c not in keys], F.lit(True).alias("__new"))
    both = current.withColumn("__old", F.lit(True)).join(fresh, keys, "full_outer")

    def value(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if c in keep or c not in new.columns:
            return F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__n_{c}")).alias(c)
        return F.when(F.col("__new"), F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c)

    return both.select(*[value(c) for c in current.columns])


def replace_partition(current: DataFrame, new: DataFrame, column: str, replaced: DataFrame) -> DataFrame:
    """``current`` without the rows of the ``replaced(column)`` values, plus ``new``."""
    return current.join(replaced.select(column), column, "left_anti").select(*current.columns).unionByName(new.select(*current.columns))


def write_partitions(df: DataFrame, path: str, column: str) -> None:
    """Overwrite just the partitions that ``df`` has. Each is written by the tasks that hold it. A value without rows
    keeps its old partition: where values may lose all their rows, write batches as ``streaming.ingest.Store`` does."""
    df.repartition(column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def latest_by_key(log: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    newest = Window.partitionBy(key).orderBy(*order)
    return log.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n")


def recent_runs(runs: DataFrame, limit: int = RECENT) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)


def latest_run_per_register(runs: DataFrame, pool: int = LATEST_POOL) -> DataFrame:
    """The latest run of each register among the ``pool`` newest runs; whole-cycle runs have none."""
    return latest_by_key(recent_runs(runs.filter(F.col("register_id").isNotNull()), pool), "register_id", [F.desc("started_at"), F.desc("run_id")])


def fold_runs(log: DataFrame) -> DataFrame:
    """Current state of runs kept as appended events ``run_id, register_id, at, status, error``."""
    return log.groupBy("run_id").agg(
        F.min_by("register_id", "at").alias("register_id"), F.min("at").alias("started_at"), F.max(F.when(F.col("status") != "running", F.col("at"))).alias("finished_at"),
        F.max_by("status", F.struct("at", (F.col("status") != "running").cast("int"))).alias("status"), F.max_by("error", "at").alias("error"),
    )


def lifecycle(outcome: Column, taken: Column) -> Column:
    """Status of a register after a run: ``ok`` is ready, and so is ``skipped`` where its content was ``taken`` in whole
    before and has not changed since; no run leaves it, others failed."""
    ready = (outcome == "ok") | ((outcome == "skipped") & taken)
    return F.when(ready, "ready").when(outcome == "running", "crawling").when(outcome.isNull() | (outcome == "skipped"), F.lit(None)).otherwise("failed")


def apply_outcomes(registers: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``outcomes(id, outcome, at, error, modified, indexer_version)`` put into the registers' state.

    The marker ``modified`` advances only on full success, so what failed is tried again.
    """
    o = outcomes.select("id", *[F.col(c).alias(f"__{c}") for c in ("outcome", "at", "error", "modified", "indexer_version")])
    done = F.col("__outcome") == "ok"
    rows = registers.join(o, "id", "left")
    new = {
        "status": F.coalesce(lifecycle(F.col("__outcome"), F.col("indexer_version").isNotNull()), "status"), "last_crawled_at": F.coalesce("__at", "last_crawled_at"), "last_crawl_status": F.coalesce("__outcome", "last_crawl_status"),
        "last_error": F.when(F.col("__outcome").isNull(), F.col("last_error")).otherwise(F.col("__error")),
        "modified": F.when(done, F.col("__modified")).otherwise(F.col("modified")), "indexer_version": F.when(done, F.col("__indexer_version")).otherwise(F.col("indexer_version")),
    }
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in registers.columns])


def not_in(current: DataFrame, keep: DataFrame, key: str = "id") -> DataFrame:
    """Keys of ``current`` that ``keep`` does not have."""
    return current.join(keep.select(key), key, "left_anti").select(key)


def without_orphans(tables: dict[str, DataFrame], orgs: DataFrame, registers: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables less all that belongs to organizations and registers no longer listed, and what was removed.

    Cascades to every table that carries the register: items, edges, search rows and vector chunks.
    """
    gone_orgs = not_in(tables["organizations"], orgs)
    gone = not_in(tables["registers"], registers).union(tables["registers"].join(gone_orgs.select(F.col("id").alias("org_id")), "org_id", "left_semi").select("id")).distinct()
    out = {"organizations": tables["organizations"].join(gone_orgs, "id", "left_anti"), "registers": tables["registers"].join(gone, "id", "left_anti")}
    for name, df in tables.items():
        if name not in out:
            out[name] = df.join(gone.select(F.col("id").alias("register_id")), "register_id", "left_anti") if "register_id" in df.columns else df
    removed = gone_orgs.select(F.lit("organization").alias("kind"), F.col("id").cast("string").alias("id")).union(gone.select(F.lit("register").alias("kind"), F.col("id").cast("string").alias("id")))
    return out, removed


def interleaved(registers: DataFrame, host: Column, position: str) -> DataFrame:
    """Round-robin over hosts: ``rank`` 1, 2, … takes every host's first, then every host's second.

    Hosts stand in the order of their first register.
    """
    own = Window.partitionBy("host").orderBy(position)
    rows = registers.withColumn("host", host).withColumn("turn", F.row_number().over(own)).withColumn("host_first", F.min(position).over(Window.partitionBy("host")))
    return rows.orderBy("turn", "host_first")


def failure_summary(failed: DataFrame) -> DataFrame:
    """``register_id, n_failed, failed_ids``."""
    lists = failed.groupBy("register_id").agg(F.count("*").alias("n_failed"), F.array_sort(F.collect_list("item_id")).alias("ids"))
    return lists.select("register_id", "n_failed", F.array_join("ids", ", ").alias("failed_ids"))
