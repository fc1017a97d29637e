"""Corpus preparation: classify, apply rules, drop near copies, sanitise, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the
last return the columns of ``documents``.

What every stage does with odd rows: null and empty texts never make it fail; the classifier and the
rules judge them like any text (the rules reject them, having under ten words), near-dedup and
sanitising leave them as they are, and packing makes them one end id. Very long texts are worked
through whole, in stretches. Repeated rows are judged alike; where they are kept, all are. Ties go by
doc_id. Rows without a doc_id stay. Extra columns pass through unchanged. Empty tables stay empty, and
so do all tables where no label says what is good.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from meridian.llm import near_dedup, packing, pii, quality_classifier, quality_rules
from meridian.llm.shared import discard, new_path
from meridian.session import ship


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good. Labels are those of ``sf_dir``, whatever documents are left."""
    return quality_classifier.keep_good(docs, _labels(ship(spark), sf_dir))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules; n-grams are counted over the documents given."""
    return quality_rules.keep_good(docs, _labels(ship(spark), sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id: shingles of five words, similarity 0.8."""
    ship(spark)
    return near_dedup.keep_first(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with cleaned texts. n_chars stays what the source said of the original text."""
    ship(spark)
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences, with each partition's certificate."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("minhash near-dedup", drop_near_copies),
    ("pii sanitisation", sanitise),
    ("best-fit packing", pack),
]

#: No stage but the last follows from SQL: the tests hold the chain against its stages and brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each from what the one before wrote; a stage's table goes when the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = new_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
