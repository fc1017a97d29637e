"""Answers as a person or a tool gets them: one JSON object for each item, and its link in the register's viewer.

A list of edges stands whole in one answer: these are for items that were asked for; analyses take the rows of ``edges``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.operators import browse


def viewer_link(viewer_url: Column, item_id: Column) -> Column:
    """The item's page in the register's viewer, null where the register has none. One slash at the end of the URL does not count."""
    return F.when(F.coalesce(viewer_url, F.lit("")) != "", F.concat(F.regexp_replace(viewer_url, "/$", ""), F.lit("/bblock/"), item_id))


def edge_lists(edges: DataFrame, node: str, other: str, name: str) -> DataFrame:
    """``id`` and the sorted list ``name`` of the other ends with their kinds, each once."""
    ends = edges.select(F.col(node).alias("id"), F.struct(F.col(other).alias("id"), "kind").alias("e")).distinct()
    return ends.groupBy("id").agg(F.array_sort(F.collect_list("e")).alias(name))


def item_answers(items: DataFrame, edges: DataFrame, registers: DataFrame) -> DataFrame:
    """``id, answer, viewer_link`` of each item: its columns, ``depends_on`` and ``dependents`` as JSON. One resolver gives both lists, and
    nulls stay in the object."""
    none = F.array().cast(f"array<struct<id:{dict(edges.dtypes)['target_id']},kind:string>>")
    rows = items.join(edge_lists(edges, "source_id", "target_id", "depends_on"), "id", "left").join(edge_lists(edges, "target_id", "source_id", "dependents"), "id", "left")
    rows = rows.join(registers.select(F.col("id").alias("register_id"), "viewer_url"), "register_id", "left")
    columns = [c for c in (*browse.SUMMARY, *items.columns) if c in items.columns]
    body = F.struct(*dict.fromkeys(columns), *[F.coalesce(c, none).alias(c) for c in ("depends_on", "dependents")])
    return rows.select("id", F.to_json(body, {"ignoreNullFields": "false"}).alias("answer"), viewer_link(F.col("viewer_url"), F.col("id").cast("string")).alias("viewer_link"))
