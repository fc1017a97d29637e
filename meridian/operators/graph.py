"""Bounded walks over the dependency graph.

Edges are walked as a table of distinct steps that is written once, or as an adjacency that is kept: both
directions in buckets of their nodes, sorted by node, of which a level reads the buckets of its frontier.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.session import checkpointed

DEEPEST, DEPTH_REST, DEPTH_TOOL = 5, 2, 1
DIRECTIONS = ("depends_on", "dependents", "both")
#: Edges of a bucket and of a file, and the most buckets: a file layout, not a limit.
BUCKET_EDGES, FILE_EDGES, MOST_BUCKETS = 4_000_000, 2_000_000, 1 << 14


def clamp_depth(depth: int) -> int:
    return max(1, min(depth, DEEPEST))


def steps_of(edges: DataFrame, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """Distinct ``source, target, kind`` of the edges, written once to the checkpoint folder: every level reads them there."""
    path = f"{checkpointed(edges.sparkSession)}/meridian-steps-{uuid.uuid4().hex}"
    steps = edges.select(F.col(source).alias("source"), F.col(target).alias("target"), "kind").distinct()
    steps.write.parquet(path)
    return edges.sparkSession.read.schema(steps.schema).parquet(path)


@dataclass(frozen=True)
class Steps:
    """What ``steps_of`` wrote: walks in both directions share it."""

    rows: DataFrame


@dataclass(frozen=True)
class Adjacency:
    """What ``write_adjacency`` wrote: for each direction ``node, other, kind`` by the bucket of the node."""

    spark: SparkSession
    path: str

    def buckets(self) -> int:
        return self.spark.read.schema("buckets int").parquet(f"{self.path}/buckets").first()[0]

    def side(self, back: bool) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{'in' if back else 'out'}")


def bucket_of(node: Column, buckets: int) -> Column:
    """A node's bucket. Numbers of different types have different ones: a value that is looked up is cast to the nodes' type first."""
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int")


def write_adjacency(edges: DataFrame, path: str, *, source: str = "source_id", target: str = "target_id") -> Adjacency:
    """Both directions, a folder for each bucket. A node that very many edges have is in one bucket and in many files of it."""
    spark = edges.sparkSession
    steps = steps_of(edges, source, target)
    n = steps.count()
    buckets = min(MOST_BUCKETS, 1 << max(0, math.ceil(n / BUCKET_EDGES) - 1).bit_length())
    files = max(1, math.ceil(n / FILE_EDGES))
    for name, node, other in (("out", "source", "target"), ("in", "target", "source")):
        placed = steps.select(F.col(node).alias("node"), F.col(other).alias("other"), "kind").withColumn("bucket", bucket_of(F.col("node"), buckets))
        dealt = placed.repartition(max(files, buckets), "bucket", F.pmod(F.xxhash64("other"), F.lit(math.ceil(files / buckets))))
        dealt.sortWithinPartitions("bucket", "node").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
    spark.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(f"{path}/buckets")
    return Adjacency(spark, path)


def adjacent(near: Adjacency, frontier: DataFrame, back: bool = False) -> DataFrame:
    """``source, target, kind`` of the edges at the nodes of ``frontier(source)``. The frontier's bucket numbers, at most as
    many as there are buckets, become a filter of folders; its nodes meet the edges in these."""
    n, side = near.buckets(), near.side(back)
    numbers = [r[0] for r in frontier.select(bucket_of(F.col("source").try_cast(side.schema["node"].dataType), n)).distinct().collect()]
    some = side.filter(F.col("bucket").isin(numbers) if numbers else F.lit(False))
    return some.select(F.col("node").alias("source"), F.col("other").alias("target"), "kind").join(frontier.select("source").distinct(), "source", "left_semi")


def walk(edges: DataFrame | Steps | Adjacency, start: object, depth: int = DEPTH_REST, *, source: str = "source_id", target: str = "target_id", back: bool = False) -> DataFrame:
    """``level, source, target, kind``: distinct edges of each level, level 1 leaving ``start``.

    Level i + 1 has all edges that leave a target of level i. Nothing is marked as visited: a cycle
    is walked again on every level, and an edge may stand in several. Joining the distinct targets
    keeps a level at most as large as the edge table. Each level but the last is written once, to the
    checkpoint folder, so the next one and the result read it instead of deriving it again. ``back`` walks an
    adjacency against its edges.
    """
    last = clamp_depth(depth)
    if isinstance(edges, Adjacency):
        spark, side = edges.spark, edges.side(back)
        at = F.lit(start).try_cast(side.schema["node"].dataType)
        first = side.filter((F.col("bucket") == bucket_of(at, edges.buckets())) & (F.col("node") == F.lit(start)))
        level, step = first.select(F.col("node").alias("source"), F.col("other").alias("target"), "kind"), lambda frontier: adjacent(edges, frontier, back)
    else:
        kept = isinstance(edges, Steps)
        own = (edges.rows if kept else edges).select(F.col(source).alias("source"), F.col(target).alias("target"), "kind")
        spark = own.sparkSession
        steps = own if kept else steps_of(own, "source", "target") if last > 1 else own.distinct()
        level, step = steps.filter(F.col("source") == F.lit(start)), lambda frontier: steps.join(frontier.distinct(), "source", "left_semi")
    checkpointed(spark)
    levels = []
    for i in range(1, last + 1):
        if i > 1:
            level = step(level.select(F.col("target").alias("source")))
        if i < last:
            level = level.checkpoint()
        levels.append(level.withColumn("level", F.lit(i)))
    return reduce(DataFrame.unionByName, levels).select("level", "source", "target", "kind")


def walk_back(edges: DataFrame | Steps | Adjacency, start: object, depth: int = DEPTH_REST, *, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """The walk against the edges; ``source`` is the node walked from, as the walk found it."""
    return walk(edges, start, depth, source=target, target=source, back=True)


def graph_edges(edges: DataFrame | Adjacency, start: object, direction: str = "both", depth: int = DEPTH_REST, *, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """Edges of the graph around ``start``, always from the depender to the dependee, without repeats."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    parts = []
    if direction == "both" and isinstance(edges, DataFrame):
        edges, source, target = Steps(steps_of(edges, source, target)), "source", "target"  # derived once for both walks
    if direction in ("depends_on", "both"):
        parts.append(walk(edges, start, depth, source=source, target=target).select("source", "target", "kind"))
    if direction in ("dependents", "both"):
        parts.append(walk_back(edges, start, depth, source=source, target=target).select(F.col("target").alias("source"), F.col("source").alias("target"), "kind"))
    return reduce(DataFrame.unionByName, parts).distinct()


def graph_nodes(found: DataFrame, start: object, nodes: DataFrame, spark_type: str = "string") -> DataFrame:
    """Start and all ends of ``found``, with the columns of ``nodes(id, name, …)``; ids it does not have
    stay as ``known = false`` under their id as name. A start that is no node and has no edge gives no rows."""
    spark = found.sparkSession
    first = nodes.filter(F.col("id") == F.lit(start)).select(F.col("id").cast(spark_type))
    ids = first.union(found.select(F.col("source").cast(spark_type))).union(found.select(F.col("target").cast(spark_type))).distinct()
    joined = ids.join(nodes.withColumn("__known", F.lit(True)), "id", "left")
    return joined.withColumn("known", F.coalesce("__known", F.lit(False))).withColumn("name", F.coalesce("name", F.col("id").cast("string"))).drop("__known")


def level_lists(levels: DataFrame) -> DataFrame:
    """``level, edges``: one sorted list per level, for answers that a person asked for; levels without edges are
    not there. A level is at most as large as the edge table: analyses take the rows of ``walk`` instead."""
    return levels.groupBy("level").agg(F.array_sort(F.collect_list(F.struct("source", "target", "kind"))).alias("edges"))
