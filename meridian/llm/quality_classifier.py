"""Supervised subword embeddings for document quality.

Every word and every character n-gram has a hashed vector; a document is the mean of its vectors and
a softmax over two classes reads it. The vectors are learned on the driver by numpy stochastic
gradient descent from a bounded sample. Softmax of a mean is linear in the vectors, so scoring needs
one number for each bucket: the gap between the two classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import binary_column, sliced, texts, tidy, word_hashes

BUCKETS, DIMENSIONS, GRAMS = 1 << 18, 8, (2, 3, 4)
#: The bound of the training sample: rows, and code points of a row that may be in it.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 50_000
EPOCHS, RATE, SEED = 6, 0.5, 7
ACCEPTED = 0.7
_SLAB = 1 << 20


def feature_ids(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of all words and character n-grams of a text, a bounded stretch at a time."""
    yield (word_hashes(text) % np.uint64(BUCKETS)).astype(np.int64)
    codes = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    widest = max(GRAMS)
    for at in range(0, len(codes), _SLAB):
        part = codes[at : at + _SLAB + widest - 1]
        own = min(_SLAB, len(codes) - at)
        key = np.zeros(len(part), np.uint32)
        for n in range(1, widest + 1):
            key = key[: len(part) - n + 1] * np.uint32(0x01000193) ^ part[n - 1 :] * np.uint32(0x9E3779B1)
            if n in GRAMS:
                yield (((key[:own] + np.uint32(n)) * np.uint32(0x85EBCA6B)) >> np.uint32(14)).astype(np.int64)


@dataclass
class Model:
    """``gap``: for each bucket, how much it moves the log odds of class 1; ``bias``: the rest of them."""

    gap: np.ndarray
    bias: float

    def score(self, text: bytes) -> float:
        total, n = 0.0, 0
        for ids in feature_ids(text):
            total += float(self.gap[ids].sum())
            n += len(ids)
        z = self.bias + total / max(1, n)
        return float(1 / (1 + np.exp(-max(-60.0, min(60.0, z)))))


@dataclass
class Learned:
    """What descent learned: a vector for each bucket, and weights and bias of each class."""

    vectors: np.ndarray
    out: np.ndarray
    bias_of: np.ndarray


def fit(texts_: list[bytes], classes: list[int]) -> Model:
    """The model of a sample; one class or none gives the smoothed base rate."""
    y = np.array(classes, np.int64)
    if not y.any() or y.all():
        return Model(np.zeros(BUCKETS), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    return trained(texts_, classes)[0]


def trained(texts_: list[bytes], classes: list[int]) -> tuple[Model, Learned]:
    """Stochastic gradient descent over documents of both classes."""
    y = np.array(classes, np.int64)
    sparse = []
    for text in texts_:
        ids, counts = np.unique(np.concatenate(list(feature_ids(text))), return_counts=True)
        sparse.append((ids.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)))
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    steps, step = EPOCHS * len(y), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            ids, share = sparse[i]
            if not len(ids):
                continue
            mean = share @ vectors[ids]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = p @ out
            out -= rate * p[:, None] * mean
            bias -= rate * p
            # a mean's gradient is spread thin over its features; their number makes up for it
            vectors[ids] -= (rate * np.float32(50)) * share[:, None] * back
    return Model((vectors @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0])), Learned(vectors, out, bias)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[bytes, int]]:
    """At most ``rows`` labelled documents outside the held-out quarter, the first in hash order.

    Of repeated labels of a document the least counts, of repeated rows the text that sorts first, so
    the sample does not depend on partitions.
    """
    marked = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long"), "quality").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    short = docs.where(F.length(F.coalesce("text", F.lit(""))) <= chars).select(F.col("doc_id").cast("long"))
    chosen = marked.join(short, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    if not chosen:
        return []
    quality = {r["doc_id"]: r["quality"] for r in chosen}
    # as many ids as ``rows`` at most
    ids = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(quality, pa.int64())}))
    short = texts(docs).where(F.length("text") <= chars)
    found = short.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    return [(r["text"].encode(), quality[r["doc_id"]]) for r in sorted(found, key=lambda r: r["doc_id"])]


def _shared_model(docs: DataFrame, labels: DataFrame, rows: int, chars: int):
    pairs = sample(docs, labels, rows, chars)
    return docs.sparkSession.sparkContext.broadcast(fit([t for t, _ in pairs], [q for _, q in pairs]))


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Whole texts are scored; null is empty, and an empty text gets the score of the bias alone.
    Repeated rows each get a row. Without labels every score is 0.5. Extra columns are ignored, and
    neither doc_id, lang, source nor a label takes part in a score.
    """
    model = _shared_model(docs, labels, rows, chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            scores = pa.array([model.value.score(t) for t in binary_column(batch, "text")], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores], ["doc_id", "score"])

    scored = texts(docs).mapInArrow(tidy(run), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPTED).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """The rows of ``docs`` that ``classify`` predicts as 1, with all their columns, without a shuffle of texts.

    Null and empty texts have the score of the bias alone; very long texts are scored whole, a stretch at
    a time; repeated rows and rows without a doc_id are judged like any; extra columns stay whatever
    their names; an empty table stays empty; without labels every score is 0.5 and nothing is kept.
    """
    model = _shared_model(docs, labels, rows, chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            mask = [model.value.score(t or b"") >= ACCEPTED for t in binary_column(batch, "text")]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
