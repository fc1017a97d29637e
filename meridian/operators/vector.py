"""Exact nearest neighbours by cosine distance.

Chunks can be kept in cells around centroids. By the triangle inequality of angles no vector of a cell is nearer
to a query than the query's angle to the centroid less the cell's radius, so a search reads cells in the order of that bound and
stops where it certifies that no cell left can hold a nearer vector.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions.scores import cosine_distance

CANDIDATES = 50
ITEM_CHUNKS = ("item_core", "item_description", "item_schema", "item_usage")
REGISTER_CHUNKS = ("register_summary",)
#: Vectors of a cell that is aimed at, the most cells (a session holds their centroids), sampled vectors for each centroid, rounds
#: of the fit, and vectors of a file. Any number of cells gives exact results.
CELL_ROWS, MOST_CELLS, SAMPLED, FITTED, FILE_ROWS = 4096, 4096, 32, 8, 200_000
#: Angles are worked out in two places; a cell is left out only if its bound is clear of the threshold.
MARGIN = 1e-6


def nearest(chunks: DataFrame, query: Sequence[float], *, key: str = "chunk_key", limit: int = CANDIDATES, filters: Column | None = None, chunk_types: Sequence[str] | None = None, vector: str = "embedding") -> DataFrame:
    """The ``limit`` nearest chunks with their ``distance``, ties by ``key``.

    Filters come first: a limit before them would lose hits. The query vector is a literal, so the
    plan is one scan, a projection and a top-N on each task; zero vectors have no distance and drop out.
    """
    rows = chunks if filters is None else chunks.filter(filters)
    if chunk_types is not None:
        rows = rows.filter(F.col("chunk_type").isin(list(chunk_types)))
    size = F.col("norm") if "norm" in chunks.columns else None
    found = rows.withColumn("distance", cosine_distance(F.col(vector), query, size)).filter(F.col("distance").isNotNull())
    return found.orderBy("distance", key).limit(limit)


def best_per_item(hits: DataFrame, item: str = "item_id") -> DataFrame:
    """``item, distance, matched_chunk_types``: the nearest chunk of each item and the sorted kinds of all its hits."""
    return hits.groupBy(item).agg(F.min("distance").alias("distance"), F.array_sort(F.collect_set("chunk_type")).alias("matched_chunk_types"))


@dataclass(frozen=True)
class Cells:
    """What ``write_cells`` wrote: ``chunks`` with ``cell`` and ``angle`` to its centroid, a folder for each cell, and the cells."""

    spark: SparkSession
    path: str
    vector: str = "embedding"

    def chunks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/chunks")

    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")


def _units(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def _centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Directions of ``cells`` groups of unit vectors, from evenly spread starts; an empty group keeps its direction."""
    out = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)]
    for _ in range(FITTED):
        nearest_one = (sample @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, nearest_one, sample)
        moved = _units(sums)
        out = np.where((moved != 0).any(axis=1, keepdims=True), moved, out)
    return out


def write_cells(chunks: DataFrame, path: str, *, key: str = "chunk_key", vector: str = "embedding") -> Cells:
    """Keep chunks by the cell of the centroid with the smallest angle. The centroids are fit on the first vectors in the order
    of their keys' hashes, at most ``SAMPLED`` for each of at most ``MOST_CELLS`` cells; every row gets a cell. Zero, null and empty vectors
    have no distance and no cell."""
    spark = chunks.sparkSession
    good = F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
    n = chunks.filter(good).count()
    cells = min(MOST_CELLS, max(1, math.ceil(n / CELL_ROWS), math.ceil(math.sqrt(n) / 8)))
    rows = chunks.filter(good).select(key, vector).orderBy(F.xxhash64(key), key).limit(SAMPLED * cells).collect()
    centroids = _centroids(_units(np.array([r[vector] for r in rows], np.float64)), cells) if rows else np.zeros((1, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                column = batch.column(vector)
                units = _units(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1))
                near = units @ centroids.T
                cell = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

    ddl = ", ".join(f"`{c}` {t}" for c, t in chunks.dtypes)
    placed = chunks.filter(good).mapInArrow(run, f"{ddl}, cell int, angle double")
    spread = max(1, math.ceil(n / FILE_ROWS / cells))
    dealt = placed.repartition(max(1, min(cells, math.ceil(n / FILE_ROWS)) * spread), "cell", F.pmod(F.xxhash64(key), F.lit(spread)))
    dealt.sortWithinPartitions("cell", "angle").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/chunks")
    kept = spark.read.schema(f"{ddl}, angle double, cell int").parquet(f"{path}/chunks")
    facts = kept.groupBy("cell").agg(F.count("*").alias("rows"), F.min("angle").alias("inner"), F.max("angle").alias("outer"))
    about = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    facts.join(about, "cell").write.mode("overwrite").parquet(f"{path}/cells")
    return Cells(spark, path, vector)


def nearest_in_cells(
    kept: Cells, query: Sequence[float], *, key: str = "chunk_key", limit: int = CANDIDATES, filters: Column | None = None,
    chunk_types: Sequence[str] | None = None, report: Callable[[dict], None] = lambda found: None,
) -> DataFrame:
    """The rows of ``nearest``, read from as few cells as the bound allows.

    Cells are read in rounds that double, in the order of the least angle that a vector of theirs can have to the query. The
    worst of the ``limit`` best so far is the threshold; when no cell left can be under it, the cells read are certain to hold
    the result, and the result is taken from them alone. ``report`` gets cells, cells read and rounds.
    """
    facts = kept.cells().collect()  # at most MOST_CELLS
    unit = _units(np.array([query], np.float64))[0] if len(query) else np.zeros(0)
    if not unit.any() or not facts:
        report({"cells": len(facts), "read": 0, "rounds": 0})
        return nearest(kept.chunks().limit(0), [1.0], key=key, limit=limit, vector=kept.vector).drop("cell", "angle")
    at = np.arccos(np.clip(np.array([r["centroid"] for r in facts]) @ unit, -1, 1))
    least = np.maximum(0, np.maximum(at - [r["outer"] for r in facts], [r["inner"] for r in facts] - at))
    order = np.argsort(least, kind="stable")
    how = {"key": key, "limit": limit, "filters": filters, "chunk_types": chunk_types, "vector": kept.vector}
    best: list[float] = []
    done, rounds, want = 0, 0, 4 * limit
    while done < len(order) and (len(best) < limit or least[order[done]] <= math.acos(max(-1.0, min(1.0, 1 - best[limit - 1]))) + MARGIN):
        some, rows = [], 0
        while done < len(order) and rows < want:
            some.append(facts[order[done]]["cell"])
            rows += facts[order[done]]["rows"]
            done += 1
        found = nearest(kept.chunks().filter(F.col("cell").isin(some)), query, **how).select("distance").collect()
        best = sorted([*best, *[r["distance"] for r in found]])[:limit]
        rounds, want = rounds + 1, 2 * want
    report({"cells": len(facts), "read": done, "rounds": rounds})
    read = [facts[i]["cell"] for i in order[:done].tolist()]
    return nearest(kept.chunks().filter(F.col("cell").isin(read)), query, **how).drop("cell", "angle")
