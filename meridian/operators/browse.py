"""Listings, lookups and details of organizations, registers and items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE, MOST_REST, MOST_SEARCH_TOOL, MOST_LIST_TOOL, MOST_BATCH = 20, 200, 50, 200, 50
#: What a listed item shows.
SUMMARY = ["id", "register_id", "name", "abstract", "status", "item_class", "version", "tags", "has_schema", "has_ld_context", "has_shacl_shapes"]


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(value, high))


def page_count(matched: int, size: int = PAGE) -> int:
    return max(1, -(-matched // size))


def offset_of(page: int, size: int = PAGE) -> int:
    return (max(1, page) - 1) * size


def where_equal(df: DataFrame, **values: object) -> DataFrame:
    """Equality filters for the arguments that are not None."""
    for name, value in values.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def where_in(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    return df.filter(F.col(column).isin(list(values))) if values else df.filter(F.lit(False))


def list_organizations(orgs: DataFrame) -> DataFrame:
    return orgs.orderBy("id")


def list_registers(registers: DataFrame, org_id: str | None = None, hidden: Sequence[str] = ()) -> DataFrame:
    """``hidden`` names the administrative columns a public listing leaves out."""
    return where_equal(registers, org_id=org_id).drop(*hidden).orderBy("id")


def by_id(df: DataFrame, key: object, column: str = "id") -> DataFrame:
    """Point lookup; the filter reaches the scan."""
    return df.filter(F.col(column) == F.lit(key))


def nested(children: DataFrame, key: str, columns: Sequence[str], name: str, order: str = "id") -> DataFrame:
    """One row per key with its children as a sorted array of structs."""
    fields = [order, *[c for c in columns if c != order]]
    return children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def with_children(parents: DataFrame, children: DataFrame, key: str, columns: Sequence[str], name: str) -> DataFrame:
    lists = nested(children, key, columns, name).withColumnRenamed(key, "__key")
    return parents.join(lists, parents.id == lists["__key"], "left").drop("__key")


def organization_detail(orgs: DataFrame, registers: DataFrame, org_id: object) -> DataFrame:
    """Both sides are filtered before the join, so only one key is ever grouped."""
    return with_children(by_id(orgs, org_id), by_id(registers, org_id, "org_id"), "org_id", ["id", "name"], "registers")


def register_detail(registers: DataFrame, items: DataFrame, register_id: object) -> DataFrame:
    return with_children(by_id(registers, register_id), by_id(items, register_id, "register_id"), "register_id", ["id", "name", "item_class"], "items")


def item_detail(items: DataFrame, edges: DataFrame, item_id: object) -> DataFrame:
    """The item with its outgoing edges ``(target_id, kind)`` and incoming ones ``(source_id, kind)``."""
    out = by_id(edges, item_id, "source_id").groupBy(F.col("source_id").alias("__out")).agg(F.array_sort(F.collect_list(F.struct("target_id", "kind"))).alias("outgoing"))
    into = by_id(edges, item_id, "target_id").groupBy(F.col("target_id").alias("__in")).agg(F.array_sort(F.collect_list(F.struct("source_id", "kind"))).alias("incoming"))
    one = by_id(items, item_id)
    return one.join(out, one.id == out["__out"], "left").join(into, one.id == into["__in"], "left").drop("__out", "__in")


def filtered_items(items: DataFrame, registers: DataFrame | None = None, *, item_class: str | None = None, status: str | None = None, register_id: object = None, org_id: object = None) -> DataFrame:
    """Items under the filters given. Registers are joined only for the organization's sake."""
    found = where_equal(items, item_class=item_class, status=status, register_id=register_id)
    if org_id is not None:
        found = found.join(by_id(registers, org_id, "org_id").select(F.col("id").alias("register_id")), "register_id", "left_semi")
    return found


def summary(items: DataFrame, *more: str) -> DataFrame:
    """The columns of a listed item that the table has, and ``more``."""
    return items.select(*[c for c in SUMMARY if c in items.columns], *more)


def page(df: DataFrame, *order: Column | str, limit: int = PAGE, offset: int = 0, most: int = MOST_REST) -> DataFrame:
    return df.orderBy(*order).offset(max(0, offset)).limit(clamp(limit, 1, most))


def browse(items: DataFrame, registers: DataFrame, *, limit: int = PAGE, offset: int = 0, most: int = MOST_REST, **filters: object) -> DataFrame:
    """One page of the matching items with ``number_matched``, the count of all of them.

    The count is a scalar subquery, so the page itself stays a top-N over the filtered scan.
    """
    found = filtered_items(items, registers, **filters)
    total = found.agg(F.count("*").alias("n"))
    return page(found, "id", limit=limit, offset=offset, most=most).withColumn("number_matched", total.scalar())


def filter_counts(items: DataFrame, registers: DataFrame) -> DataFrame:
    """``item_class, status, register_id, org_id, n``: how many items have each combination of what can be filtered by. Kept beside the
    items, it gives the count of any filter from as many rows as there are combinations."""
    known = [c for c in ("item_class", "status", "register_id") if c in items.columns]
    orgs = registers.select(F.col("id").alias("register_id"), "org_id")
    return items.groupBy(*known).agg(F.count("*").alias("n")).join(orgs, "register_id", "left")


def browse_after(items: DataFrame, registers: DataFrame, counts: DataFrame, after: object = None, *, limit: int = PAGE, most: int = MOST_REST, **filters: object) -> DataFrame:
    """The page of matching items whose ids follow ``after``, the last id of the page before, or the first page; with
    ``number_matched`` from ``filter_counts``.

    The cursor is a range filter that reaches the scan, so a late page reads what an early one does, where an offset reads and
    drops all pages before. Ids are distinct.
    """
    found = filtered_items(items, registers, **filters)
    if after is not None:
        found = found.filter(F.col("id") > F.lit(after))
    total = where_equal(counts, **filters).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return page(found, "id", limit=limit, most=most).withColumn("number_matched", total.scalar())


def hydrate(ranked: DataFrame, items: DataFrame, key: str = "item_id") -> DataFrame:
    """Items of ``ranked(key, score, rank)`` in rank order; ids without an item drop out."""
    return ranked.join(items.withColumnRenamed("id", key), key).orderBy("rank")


def batch_get(items: DataFrame, ids: Sequence[object], most: int = MOST_BATCH) -> DataFrame:
    """The first ``most`` ids in the order asked, with ``found``; missing ones have null columns."""
    spark = items.sparkSession
    wanted = list(dict.fromkeys(ids))[:most]
    kind = dict(items.dtypes)["id"]
    asked = spark.createDataFrame([(i, str(x)) for i, x in enumerate(wanted)], "rank int, asked string").select("rank", F.col("asked").cast(kind).alias("asked"))
    mine = where_in(items, "id", wanted)
    return F.broadcast(asked).join(mine, F.col("asked") == mine.id, "left").withColumn("found", F.col("id").isNotNull()).orderBy("rank")
