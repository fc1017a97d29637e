"""Ranking expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Term saturation, length normalisation, floor of a common term's weight.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
SEMANTIC_WEIGHT = 0.75


def idf(n_rows: Column, n_with: Column) -> Column:
    value = F.ln((n_rows - n_with + F.lit(0.5)) / (n_with + F.lit(0.5)))
    return F.when(value <= 0, F.lit(IDF_FLOOR)).otherwise(value)


def bm25_term(weight: Column, tf: Column, length: Column, mean_length: Column) -> Column:
    """Positive: larger is better."""
    return weight * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / mean_length))


def keyword_score(relevance: Column) -> Column:
    m = F.greatest(F.lit(0.0), relevance)
    return m / (F.lit(1.0) + m)


def semantic_score(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - distance)


def fused(semantic: Column, keyword: Column, weight: float = SEMANTIC_WEIGHT) -> Column:
    return F.lit(weight) * semantic + F.lit(1 - weight) * keyword


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(vector: Column, query: Sequence[float], vector_norm: Column | None = None) -> Column:
    """Distance to a literal query vector; null where either vector is zero or the widths differ."""
    length = math.sqrt(sum(float(x) ** 2 for x in query))
    size = vector_norm if vector_norm is not None else norm(vector)
    q = F.array(*[F.lit(float(x)) for x in query]) if query else F.array().cast("array<double>")
    fits = (F.size(vector) == len(query)) & (size > 0) & F.lit(length > 0)
    return F.when(fits, F.lit(1.0) - dot(vector, q) / (size * F.lit(length)))
