"""Catalog tables under one folder, changed by transactions.

A transaction writes its rows beside what is there and then a manifest, which is the one step that counts:
it names the live folders of each table and the state of all registers. A manifest is created under a
number that must be free, so of two writers one fails and leaves nothing. Readers take the newest
manifest and open the folders that it names; rows of a register that was written anew or dropped
since are told by the state, and a folder in which no register counts any more is no longer named.

Kinds of tables: ``rows`` belong to registers and are replaced with them, ``log`` only grows, ``whole`` is
written as one. ``compact`` rewrites live rows into one folder, ``expire`` deletes what no kept manifest names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is known of a register: its newest run, what it had when it was last taken in whole, and where its rows count from.
STATE = "id string, run_id string, modified string, outcome string, error string, at timestamp, status string, stored string, version int, batch long"
#: Folders of one table from which on ``tidy`` compacts, manifests that ``expire`` keeps.
MOST_FOLDERS, KEPT_MANIFESTS = 16, 3
#: Parts of a partition when a partitioned table is compacted.
SPREAD = 16
_NOTHING: dict = {"folders": [], "partitions": []}


class Conflict(RuntimeError):
    """Another transaction was faster; nothing of this one is left."""


def schema_columns(ddl: str) -> list[str]:
    """The columns of a DDL schema, without splitting inside types."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


@dataclass(frozen=True)
class Store:
    root: str

    def _files(self, spark: SparkSession, path: str) -> tuple:
        """Hadoop's file system and path: stores may be where only Spark reads."""
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where

    def _names(self, spark: SparkSession, path: str) -> list[str]:
        fs, where = self._files(spark, path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def delete(self, spark: SparkSession, path: str) -> None:
        fs, where = self._files(spark, path)
        fs.delete(where, True)

    def versions(self, spark: SparkSession) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names(spark, "manifest") if n.endswith(".json") and not n.startswith(".")]

    def manifest(self, spark: SparkSession, version: int | None = None) -> dict:
        """The newest manifest, or one of the kept ones; an empty one before the first transaction."""
        if version is None:
            version = max(self.versions(spark), default=-1)
        if version < 0:
            return {"version": -1, "tables": {}, "taken": {}, "written": {}, "live": {}, "state": None}
        fs, where = self._files(spark, f"manifest/{version:012d}.json")
        stream = fs.open(where)
        try:
            return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, spark: SparkSession, manifest: dict) -> None:
        """Write the manifest beside and give it its number, which nobody else may have."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        fs, beside = self._files(spark, f"manifest/.{uuid.uuid4().hex}")
        _, named = self._files(spark, f"manifest/{manifest['version']:012d}.json")
        stream = fs.create(beside, True)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(beside), fs.makeQualified(named), how)
        except Py4JJavaError as e:
            fs.delete(beside, False)
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                raise Conflict(f"version {manifest['version']} is taken") from e
            raise

    def state(self, spark: SparkSession, manifest: dict | None = None) -> DataFrame:
        """A row for each register, as ``STATE``."""
        held = (manifest or self.manifest(spark))["state"]
        return spark.read.schema(STATE).parquet(f"{self.root}/{held}") if held else spark.createDataFrame([], STATE)

    def markers(self, spark: SparkSession, manifest: dict | None = None) -> DataFrame:
        """``id, stored, version``: what each register had when it last was taken in whole."""
        return self.state(spark, manifest).filter("version is not null").select("id", "stored", "version")

    def _folders(self, spark: SparkSession, schema: str, folders: list[dict], partitioned: bool) -> DataFrame:
        schema = f"{schema}, batch long"
        if not folders:
            return spark.createDataFrame([], schema)
        paths = [f"{self.root}/{f['path']}" for f in folders]
        if partitioned:  # each folder is a root of its own
            return reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(path) for path in paths])
        return spark.read.schema(schema).parquet(*paths)

    def read(self, spark: SparkSession, name: str, schema: str, manifest: dict | None = None) -> DataFrame:
        """All rows of a ``log`` or ``whole`` table, with ``batch``, the version that wrote them."""
        held = (manifest or self.manifest(spark))["tables"].get(name, _NOTHING)
        return self._folders(spark, schema, held["folders"], bool(held["partitions"]))

    def current(self, spark: SparkSession, name: str, schema: str, manifest: dict | None = None) -> DataFrame:
        """The rows that count of a ``rows`` table, which has a ``register_id``.

        Only live folders are opened. One all of whose registers still count is read as it is, the others meet the state.
        """
        manifest = manifest or self.manifest(spark)
        held, partitioned = (manifest["tables"].get(name, _NOTHING)[k] for k in ("folders", "partitions"))
        whole = lambda f: manifest["live"].get(str(f["batch"]), 0) == manifest["written"].get(str(f["batch"]))
        columns = [c.split()[0] for c in schema_columns(schema)]
        parts = []
        if clean := [f for f in held if whole(f)]:
            parts.append(self._folders(spark, schema, clean, bool(partitioned)).select(*columns))
        if stale := [f for f in held if not whole(f)]:
            live = self.state(spark, manifest).select(F.col("id").alias("register_id"), "batch")
            parts.append(self._folders(spark, schema, stale, bool(partitioned)).join(live, ["register_id", "batch"], "left_semi").select(*columns))
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)

    def newest(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        """A ``whole`` table."""
        return self.read(spark, name, schema).drop("batch")

    def begin(self, spark: SparkSession) -> Transaction:
        return Transaction(self, spark, self.manifest(spark))

    def compact(self, spark: SparkSession) -> int:
        """Rewrite what counts of every table into one folder each; returns the version. Readers see the same rows."""
        tx = self.begin(spark)
        try:
            for name, held in tx.base["tables"].items():
                ddl = ", ".join(f"{c} {t}" for c, t in held["columns"] if c != "batch")
                if held["kind"] == "rows":
                    rows = self.current(spark, name, ddl, tx.base)
                else:
                    rows = self.read(spark, name, ddl, tx.base)
                if held["partitions"]:
                    rows = rows.repartition(*held["partitions"], F.pmod(F.xxhash64("register_id"), F.lit(SPREAD)))
                if held["order"]:
                    rows = rows.sortWithinPartitions(*held["order"])
                tx.rewrite(name, rows, held)
            return tx.commit(state=self.state(spark, tx.base).withColumn("batch", F.when(F.col("batch").isNotNull(), F.lit(tx.version).cast("long"))))
        except BaseException:
            tx.abort()
            raise

    def expire(self, spark: SparkSession, keep: int = KEPT_MANIFESTS) -> list[str]:
        """Delete all but the newest ``keep`` manifests, and the folders that none of these names. Returns the folders' names.

        A folder of a transaction that has not ended has a newer number than any manifest and stays.
        """
        versions = sorted(self.versions(spark))
        kept = versions[-max(1, keep) :]
        named = set()
        for version in kept:
            manifest = self.manifest(spark, version)
            paths = [f["path"] for held in manifest["tables"].values() for f in held["folders"]] + ([manifest["state"]] if manifest["state"] else [])
            named |= {p.split("/")[1] for p in paths}
        gone = [n for n in self._names(spark, "data") if n not in named and kept and int(n.split("-")[0]) <= kept[-1]]
        for version in versions[: -max(1, keep)]:
            self.delete(spark, f"manifest/{version:012d}.json")
        for name in gone:
            self.delete(spark, f"data/{name}")
        return gone

    def tidy(self, spark: SparkSession, most: int = MOST_FOLDERS, keep: int = KEPT_MANIFESTS) -> bool:
        """Compact where a table has more than ``most`` folders, and delete what is no longer named."""
        full = any(len(held["folders"]) > most for held in self.manifest(spark)["tables"].values())
        if full:
            self.compact(spark)
        self.expire(spark, keep)
        return full


@dataclass
class Transaction:
    store: Store
    spark: SparkSession
    base: dict
    written: dict[str, dict] = field(default_factory=dict)
    again: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.version = self.base["version"] + 1
        self.folder = f"data/{self.version:012d}-{uuid.uuid4().hex[:12]}"

    def write(self, name: str, rows: DataFrame, *partitions: str, kind: str = "rows", order: tuple[str, ...] = ()) -> None:
        """Rows of this transaction. A ``log`` gets them added, a ``whole`` table is replaced by them, and of ``rows`` those of
        the registers that ``commit`` says are replaced take the place of what these registers had."""
        rows = rows.drop("batch").withColumn("batch", F.lit(self.version).cast("long"))
        path = f"{self.folder}/{name}"
        rows.write.partitionBy(*partitions).parquet(f"{self.store.root}/{path}")
        self.written[name] = {"kind": kind, "partitions": list(partitions), "order": list(order), "columns": rows.dtypes, "folders": [{"path": path, "batch": self.version}]}

    def written_rows(self, name: str) -> DataFrame:
        """What this transaction wrote of a table."""
        return self.spark.read.parquet(f"{self.store.root}/{self.written[name]['folders'][0]['path']}")

    def rewrite(self, name: str, rows: DataFrame, held: dict) -> None:
        """All that counts of a table, in place of its folders. A log's rows keep the version that wrote them."""
        path = f"{self.folder}/{name}"
        if held["kind"] != "log":
            rows = rows.drop("batch").withColumn("batch", F.lit(self.version).cast("long"))
        rows.write.partitionBy(*held["partitions"]).parquet(f"{self.store.root}/{path}")
        self.written[name] = held | {"folders": [{"path": path, "batch": self.version}]}
        self.again.add(name)

    def commit(self, done: DataFrame | None = None, *, keep: DataFrame | None = None, taken: tuple[str, int] | None = None, state: DataFrame | None = None) -> int:
        """Make it count. ``done(id, run_id, modified, indexer_version, outcome, error, at, replaced)`` are runs of registers;
        registers that ``keep(id)`` does not have are dropped with all their rows. ``taken`` remembers a source's batch."""
        try:
            tables = {n: dict(held) for n, held in self.base["tables"].items()}
            for name, held in self.written.items():
                before = tables.get(name, {"folders": []})["folders"] if held["kind"] != "whole" and name not in self.again else []
                tables[name] = held | {"folders": before + held["folders"]}
            out = dict(self.base, version=self.version, tables=tables)
            if taken:
                out["taken"] = self.base["taken"] | {taken[0]: taken[1]}
            if state is None and (done is not None or keep is not None):
                state = self._states(done, keep)
            if state is not None:
                out["state"] = f"{self.folder}/state"
                state.select(*[c.split()[0] for c in STATE.split(", ")]).write.parquet(f"{self.store.root}/{out['state']}")
                counts = self.store.state(self.spark, out).filter("batch is not null").groupBy("batch").count().collect()  # as many as live folders
                out["live"] = {str(r["batch"]): r["count"] for r in counts}
                written = self.base["written"] | {str(self.version): out["live"].get(str(self.version), 0)}
                out["written"] = {b: n for b, n in written.items() if b in out["live"]}
                for held in tables.values():
                    if held["kind"] == "rows":
                        held["folders"] = [f for f in held["folders"] if str(f["batch"]) in out["live"]]
            self.store.publish(self.spark, out)
            return self.version
        except BaseException:
            self.abort()
            raise

    def _states(self, done: DataFrame | None, keep: DataFrame | None) -> DataFrame:
        state = self.store.state(self.spark, self.base)
        if done is not None:
            was, now = state.alias("was"), done.alias("now")
            rows, new = was.join(now, F.col("was.id") == F.col("now.id"), "full_outer"), F.col("now.id").isNotNull()
            good = F.coalesce(F.col("now.outcome") == "ok", F.lit(False))
            newest = [F.when(new, F.col(f"now.{c}")).otherwise(F.col(f"was.{c}")).alias(c) for c in ("run_id", "modified", "outcome", "error", "at")]
            # a register is skipped because it was taken in whole as it is now
            status = F.when(new, F.when(F.col("now.outcome").isin("ok", "skipped"), "ready").otherwise("failed")).otherwise(F.col("was.status"))
            state = rows.select(
                F.coalesce("now.id", "was.id").alias("id"), *newest, status.alias("status"),
                F.when(good, F.col("now.modified")).otherwise(F.col("was.stored")).alias("stored"), F.when(good, F.col("now.indexer_version")).otherwise(F.col("was.version")).alias("version"),
                F.when(F.coalesce("now.replaced", F.lit(False)), F.lit(self.version).cast("long")).otherwise(F.col("was.batch")).alias("batch"),
            )
        return state if keep is None else state.join(keep.select("id").distinct(), "id", "left_semi")

    def abort(self) -> None:
        """Nothing of the transaction is left."""
        self.store.delete(self.spark, self.folder)
