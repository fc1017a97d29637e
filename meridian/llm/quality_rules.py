"""Quality rules: exact counts of each text, and a hashed n-gram log-likelihood ratio.

Byte n-grams of all documents, hashed into a fixed number of buckets, make one multinomial, those of
the trusted documents another. A text's mean log ratio of the two tells whether it reads like the
trusted ones; texts under a fixed threshold go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import binary_column, sliced, texts, texts_in, tidy, word_segments

GRAM, BUCKETS = 4, 1 << 16
#: Times that every bucket is taken to be seen besides, in the trusted texts and as often expected there: what few
#: trusted texts merely miss does not count against a document, and a bucket weighs as much as there is
#: evidence of it, whatever the size of the rest.
PRIOR = 10.0
THRESHOLD = -0.3
_SLAB = 1 << 20
_SPACES = b" \t\n\r\x0b\x0c"
_CONTINUED = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"


def repeated_words(ids: np.ndarray, distinct: int, width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur at least twice."""
    if len(ids) <= width:
        return 0
    n = len(ids) - width + 1
    if max(distinct, 2) ** width < 2**62:
        keys = np.zeros(n, np.int64)
        for i in range(width):
            keys = keys * distinct + ids[i : i + n]
    else:  # ranks of prefixes stay below the number of words
        keys = ids[:n]
        for i in range(1, width):
            keys = np.unique(keys * distinct + ids[i : i + n], return_inverse=True)[1]
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    inside = np.zeros(len(ids), bool)
    again = np.isin(keys, twice)
    for i in range(width):
        inside[i : i + n] |= again
    return int(inside.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    known: dict[bytes, int] = {}
    parts = [np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) for words in word_segments(text)]
    ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
    lines = [line for line in text.split(b"\n") if line.strip()]
    chars = len(text.translate(None, _SPACES + _CONTINUED))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    return len(ids), chars, symbols, len(lines) - len(set(lines)), repeated_words(ids, len(known))


def grams(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of a text's byte n-grams, a bounded stretch at a time."""
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(0, len(data) - GRAM + 1), _SLAB):
        part = data[at : at + _SLAB + GRAM - 1].astype(np.uint32)
        n = len(part) - GRAM + 1
        key = part[:n] | part[1 : n + 1] << np.uint32(8) | part[2 : n + 2] << np.uint32(16) | part[3 : n + 3] << np.uint32(24)
        yield (key * np.uint32(0x9E3779B1)) >> np.uint32(16)


def gram_counts(texts_: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts: a fixed number of rows from each task, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        held, size = [], 0
        for batch in batches:
            for text in binary_column(batch, "text"):
                for part in grams(text):
                    held.append(part)
                    size += len(part)
                    if size >= _SLAB:
                        total += np.bincount(np.concatenate(held), minlength=BUCKETS)
                        held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for row in texts_.select("text").mapInArrow(tidy(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of the documents that ``labels`` marks as quality 1.

    The labels may outgrow any broadcast, so fixed-size filters of their ids pick the texts.
    """
    return texts_in(docs, labels.where("quality = 1").select(F.col("doc_id").cast("long")).distinct())


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p(bucket | trusted) - log p(bucket | all), both smoothed; nothing where no document is trusted."""
    if not target.sum():
        return np.zeros(BUCKETS)
    expected = raw / raw.sum() * target.sum()
    return np.log((target + PRIOR) / (expected + PRIOR))


def _shared_ratios(docs: DataFrame, labels: DataFrame):
    ratios = log_ratios(gram_counts(trusted_texts(docs, labels)), gram_counts(texts(docs)))
    return docs.sparkSession.sparkContext.broadcast(ratios)


def judged(text: bytes, table: np.ndarray, threshold: float) -> tuple:
    words, chars, symbols, dups, repeats = base_counts(text)
    llr = sum(float(table[g].sum()) for g in grams(text)) / max(1, len(text) - GRAM + 1)
    failed = words < 10 or 100 * repeats > 20 * words
    return words, chars, symbols, dups, repeats, failed, llr, not failed and llr >= threshold


def apply_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the base counts, ``base_failed``, ``llr`` and ``kept``.

    base_failed: under 10 words, or over a fifth of the words in repeated five-word windows. kept:
    not base_failed and a mean log ratio of at least ``threshold``. Null and empty texts have no
    words, a ratio of 0, and fail. Without trusted documents every ratio is 0. Repeated rows each get
    a row and count as often as they occur; a document with both labels is trusted. A ratio equal to the
    threshold is kept. Very long texts go through in stretches. Extra columns are ignored; an empty
    table gives no rows.
    """
    shared = _shared_ratios(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in sliced(batches):
            rows = [judged(text, table, threshold) for text in binary_column(batch, "text")]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 8, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"
    return texts(docs).mapInArrow(tidy(run), schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``apply_rules`` keeps, with all their columns, without a shuffle of texts.

    Null, empty and very long texts, repeated rows and missing labels count as there; rows without a
    doc_id are judged but never trusted; extra columns stay whatever their names; an empty table stays empty.
    """
    shared = _shared_ratios(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            mask = [judged(text or b"", shared.value, threshold)[-1] for text in binary_column(batch, "text")]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The query's rows as DuckDB SQL, the ratio to six digits."""
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
e AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
v AS (SELECT r, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS v FROM e WINDOW o AS (PARTITION BY r ORDER BY i)),
s AS (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS n FROM v WHERE v IS NOT NULL),
p AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS k FROM s WHERE n > 1) GROUP BY r),
b AS (SELECT r, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b, unnest(range(1, octet_length(encode(text)) + 1)) AS i FROM d),
q AS (SELECT r, lead(b, 3) OVER o AS b3, lead(b, 2) OVER o || lead(b, 1) OVER o || b AS rest FROM b WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, ((('0x' || b3 || rest)::UBIGINT * 2654435761::UBIGINT) % 4294967296::UBIGINT) >> 16 AS g FROM q WHERE b3 IS NOT NULL),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
c AS (SELECT g, count(*)::DOUBLE AS n, count(good.doc_id)::DOUBLE AS t FROM g JOIN d USING (r) LEFT JOIN good ON good.doc_id = d.doc_id GROUP BY g),
x AS (SELECT g, CASE WHEN sum(t) OVER () = 0 THEN 0 ELSE ln((t + {PRIOR}) / (n / sum(n) OVER () * sum(t) OVER () + {PRIOR})) END AS x FROM c),
y AS (SELECT r, avg(x) AS llr FROM g JOIN x USING (g) GROUP BY r),
a AS (SELECT doc_id, len(w.w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l.l) - len(list_distinct(l.l)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, coalesce(y.llr, 0) AS llr
  FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN p USING (r) LEFT JOIN y USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, round(llr, 6) + 0 AS llr, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND llr >= {threshold} AS kept FROM a
"""
