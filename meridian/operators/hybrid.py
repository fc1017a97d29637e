"""Fusion of keyword and vector search."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.scores import SEMANTIC_WEIGHT, fused, keyword_score, semantic_score
from meridian.operators.vector import best_per_item


def fuse(keyword: DataFrame, semantic: DataFrame | None, *, key: str = "item_id", weight: float = SEMANTIC_WEIGHT) -> DataFrame:
    """``key, score, matched_chunk_types`` over both sides' candidates.

    ``keyword(key, relevance)``, ``semantic(key, distance, matched_chunk_types)``. A side that does
    not have an item counts 0; without a semantic side the keyword score stands alone.
    """
    words = keyword.select(key, keyword_score(F.col("relevance")).alias("kw"))
    none = F.array().cast("array<string>")
    if semantic is None:
        return words.select(key, F.col("kw").alias("score"), none.alias("matched_chunk_types"))
    near = semantic.select(key, semantic_score(F.col("distance")).alias("sem"), F.col("matched_chunk_types").cast("array<string>"))
    score = fused(F.coalesce("sem", F.lit(0.0)), F.coalesce("kw", F.lit(0.0)), weight)
    return words.join(near, key, "full_outer").select(key, score.alias("score"), F.coalesce("matched_chunk_types", none).alias("matched_chunk_types"))


def ranked(scored: DataFrame, *, key: str = "item_id", limit: int = 20, offset: int = 0) -> DataFrame:
    """One page with ``rank`` and ``number_matched``. The candidates are a bounded pool by then."""
    order = Window.orderBy(F.desc("score"), key)
    out = scored.withColumn("rank", F.row_number().over(order)).withColumn("number_matched", F.count("*").over(Window.partitionBy()))
    return out.filter((F.col("rank") > offset) & (F.col("rank") <= offset + limit)).orderBy("rank")


def hybrid_search(keyword: DataFrame, neighbours: Callable[[Sequence[float]], DataFrame], embed: Callable[[str], Sequence[float]], query: str, *, key: str = "item_id", strict: bool = False, weight: float = SEMANTIC_WEIGHT, limit: int = 20, offset: int = 0) -> DataFrame:
    """Keyword candidates and nearest chunks, fused and paged.

    ``strict`` leaves the vectors out. If the query cannot be embedded or the nearest chunks cannot
    be computed, the keyword result stands alone; the bounded semantic side is computed here, for a
    lazy plan would fail later.
    """
    semantic = None
    if not strict:
        try:
            found = best_per_item(neighbours(embed(query)), key)
            rows = found.collect()  # at most as many as candidates
            semantic = keyword.sparkSession.createDataFrame(rows, found.schema)
        except (PySparkException, OSError, ValueError, RuntimeError):
            semantic = None
    return ranked(fuse(keyword, semantic, key=key, weight=weight), key=key, limit=limit, offset=offset)


def boost_terms(scored: DataFrame, matches: DataFrame, *, key: str = "item_id", weight: float = 0.2) -> DataFrame:
    """``min(1, score + weight * match)`` for items that ``matches(key, match)`` ties to an ontology term."""
    return scored.join(matches, key, "left").withColumn("score", F.least(F.lit(1.0), F.col("score") + F.lit(weight) * F.coalesce("match", F.lit(0.0)))).drop("match")
