"""Change detection and ownership of identifiers as state of a stream.

Registers are one keyed state: the marker and the identifiers of a register's last document. A document whose marker
has not moved gives nothing; of another only what it claims anew or gives up goes on. Identifiers are the second one:
the registers that claim an identifier now, each since when. The first still standing claim owns it, so an owner that
gives an identifier up hands it to the next claimant without a new document of that one. Neither state is ever read
whole, and a batch touches only the keys it has.

``standing_claims`` says the same of a log of documents, as one batch query.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What the stream gets: documents in the order of ``seq``; items may repeat, null is no document.
DOCUMENTS = "register_id string, seq long, modified string, items array<string>"
CHANGES = "item_id string, register_id string, seq long, present boolean"
OWNERS = "item_id string, seq long, owner string, before string"


class RegisterChanges(StatefulProcessor):
    """Of a register's documents, the identifiers that one claims anew or no longer has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marker = handle.getValueState("marker", "modified string, known boolean")
        self.held = handle.getMapState("held", "item_id string", "one int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        for row in sorted((r for part in rows for r in part.itertuples(index=False)), key=lambda r: (r.seq, r.modified or "")):
            modified = row.modified if isinstance(row.modified, str) else None
            known = self.marker.get()
            if row.items is None or (known is not None and known[1] and known[0] == modified):
                continue
            now = dict.fromkeys(i for i in row.items if i)
            was = {k[0] for k in self.held.keys()} if self.held.exists() else set()
            for item in sorted(was - now.keys()):
                self.held.removeKey((item,))
                out.append((item, key[0], row.seq, False))
            for item in now:
                if item not in was:
                    self.held.updateValue((item,), (1,))
                    out.append((item, key[0], row.seq, True))
            self.marker.update((modified, True))
        yield pd.DataFrame(out, columns=["item_id", "register_id", "seq", "present"])

    def close(self) -> None:
        pass


class ItemOwners(StatefulProcessor):
    """Of an identifier's claims, who owns it after a batch, where that has changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.claims = handle.getMapState("claims", "register_id string", "since long")
        self.owner = handle.getValueState("owner", "register_id string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = -1
        for row in sorted((r for part in rows for r in part.itertuples(index=False)), key=lambda r: r.seq):
            last = max(last, int(row.seq))
            if row.present:
                self.claims.updateValue((row.register_id,), (int(row.seq),))
            elif self.claims.containsKey((row.register_id,)):
                self.claims.removeKey((row.register_id,))
        best = min(((since[0], register[0]) for register, since in self.claims.iterator()), default=None) if self.claims.exists() else None
        held = self.owner.get()
        before, now = held[0] if held else None, best[1] if best else None
        if now != before:
            self.owner.update((now,))
            yield pd.DataFrame([(key[0], last, now, before)], columns=["item_id", "seq", "owner", "before"])
        else:
            yield pd.DataFrame(columns=["item_id", "seq", "owner", "before"])

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state of this kind lives in the engine's RocksDB store, whose changes go to the checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def register_changes(documents: DataFrame) -> DataFrame:
    """``CHANGES`` of a stream of ``DOCUMENTS``."""
    use_rocksdb(documents.sparkSession)
    return documents.groupBy("register_id").transformWithStateInPandas(RegisterChanges(), CHANGES, "Append", "None")


def owner_changes(changes: DataFrame) -> DataFrame:
    """``OWNERS`` of a stream of ``CHANGES``: the identifiers whose owner is another one after a batch, null for none."""
    use_rocksdb(changes.sparkSession)
    return changes.groupBy("item_id").transformWithStateInPandas(ItemOwners(), OWNERS, "Append", "None")


def current_owners(log: DataFrame) -> DataFrame:
    """``item_id, owner`` of all owned identifiers, from the log that ``owner_changes`` wrote."""
    return log.groupBy("item_id").agg(F.max_by("owner", "seq").alias("owner")).filter("owner is not null")


def standing_claims(documents: DataFrame) -> DataFrame:
    """``item_id, register_id, since, owner`` of all claims that stand after a log of ``DOCUMENTS`` with distinct register and seq.

    A claim stands if the register's last document that counted has the item, and since the first of the unbroken
    run of such documents. A document whose marker is that of the one before, or that is null, does not count.
    """
    order = Window.partitionBy("register_id").orderBy("seq")
    real = documents.filter(F.col("items").isNotNull())
    real = real.withColumns({"__before": F.lag("modified").over(order), "__first": F.row_number().over(order) == 1})
    counted = real.filter(F.col("__first") | ~F.col("modified").eqNullSafe(F.col("__before")))
    numbered = counted.withColumn("n", F.row_number().over(order)).withColumn("last", F.count("*").over(Window.partitionBy("register_id")))
    each = numbered.select("register_id", "seq", "n", "last", F.explode(F.array_distinct(F.filter("items", lambda x: x.isNotNull() & (x != "")))).alias("item_id"))
    # in an unbroken run up to the last document, the documents' numbers fall as fast as the places counted from the end
    place = Window.partitionBy("register_id", "item_id").orderBy(F.desc("n"))
    run = each.withColumn("from_end", F.row_number().over(place)).filter(F.col("last") - F.col("n") + 1 == F.col("from_end"))
    claims = run.groupBy("item_id", "register_id").agg(F.min("seq").alias("since"))
    owner = F.min(F.struct("since", "register_id")).over(Window.partitionBy("item_id"))["register_id"]
    return claims.select("item_id", "register_id", "since", owner.alias("owner"))
