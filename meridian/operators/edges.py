"""Dependency edges: lookups, batches, and the roll-up to registers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outgoing(edges: DataFrame, node: object) -> DataFrame:
    return edges.filter(F.col("source_id") == F.lit(node)).select("target_id", "kind")


def incoming(edges: DataFrame, node: object) -> DataFrame:
    return edges.filter(F.col("target_id") == F.lit(node)).select("source_id", "kind")


def batched(edges: DataFrame, ids: DataFrame, direction: str = "out") -> DataFrame:
    """``id, edges`` for every id of ``ids(id)``, with an empty list where there are none."""
    key, other = ("source_id", "target_id") if direction == "out" else ("target_id", "source_id")
    own = edges.join(ids.select(F.col("id").alias(key)), key, "left_semi")
    lists = own.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(F.struct(other, "kind"))).alias("edges"))
    empty = F.array().cast(lists.schema["edges"].dataType)
    return ids.select("id").distinct().join(lists, "id", "left").withColumn("edges", F.coalesce("edges", empty))


def roll_up(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Distinct ``source_register_id, target_register_id, kind`` of edges that leave their register.

    ``owners(id, register_id)``. Targets without an owner have no register and drop out. This is a
    view over all edges, so it does not depend on the order in which registers came in.
    """
    source = owners.select(F.col("id").alias("source_id"), F.col("register_id").alias("source_register_id"))
    target = owners.select(F.col("id").alias("target_id"), F.col("register_id").alias("target_register_id"))
    crossing = edges.join(source, "source_id").join(target, "target_id").filter(F.col("source_register_id") != F.col("target_register_id"))
    return crossing.select("source_register_id", "target_register_id", "kind").distinct()


def crossings(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """``source_register_id, target_register_id, kind, n``: of how many edges each row of ``roll_up`` is made."""
    source = owners.select(F.col("id").alias("source_id"), F.col("register_id").alias("source_register_id"))
    target = owners.select(F.col("id").alias("target_id"), F.col("register_id").alias("target_register_id"))
    own = edges.select("source_id", "target_id", "kind").distinct()
    met = own.join(source, "source_id").join(target, "target_id").filter(F.col("source_register_id") != F.col("target_register_id"))
    return met.groupBy("source_register_id", "target_register_id", "kind").agg(F.count("*").alias("n"))


def crossing_changes(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], registers: DataFrame) -> DataFrame:
    """What a batch adds to ``crossings`` and takes from them: ``n`` may be negative.

    ``before`` and ``after`` are edges and owners, ``registers(register_id)`` those that the batch wrote anew. Only edges that
    leave an item of these registers, or lead to an item that changed hands, are counted.
    """
    (old_edges, old_owners), (new_edges, new_owners) = before, after
    mine = lambda owners: owners.join(registers, "register_id", "left_semi").select("id", "register_id")
    was, now = mine(old_owners), mine(new_owners)
    # items that left one of the registers, came to one, or stayed in it
    touched = was.select("id").union(now.select("id")).distinct()
    old, new = old_owners.join(touched, "id", "left_semi").select("id", F.col("register_id").alias("o")), new_owners.join(touched, "id", "left_semi").select("id", F.col("register_id").alias("w"))
    moved = old.join(new, "id", "full_outer").filter(~F.col("o").eqNullSafe(F.col("w"))).select("id")

    def counted(edges: DataFrame, owners: DataFrame) -> DataFrame:
        leaving = edges.join(touched.select(F.col("id").alias("source_id")), "source_id", "left_semi").select("source_id", "target_id", "kind")
        leading = edges.join(moved.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id", "kind")
        return crossings(leaving.union(leading), owners)

    return counted(new_edges, new_owners).unionByName(counted(old_edges, old_owners).withColumn("n", -F.col("n")))


def with_changes(kept: DataFrame, changes: DataFrame) -> DataFrame:
    """``crossings`` after a batch; a row of which nothing is left is gone."""
    keys = ["source_register_id", "target_register_id", "kind"]
    return kept.select(*keys, "n").unionByName(changes.select(*keys, "n")).groupBy(*keys).agg(F.sum("n").alias("n")).filter("n <> 0")


def replace_outgoing(edges: DataFrame, sources: DataFrame, new: DataFrame) -> DataFrame:
    """``edges`` with all edges of ``sources(source_id)`` replaced by ``new``; repeated new edges count once."""
    return edges.join(sources, "source_id", "left_anti").select("source_id", "target_id", "kind").unionByName(new.select("source_id", "target_id", "kind").distinct())
