r"""Removal of passages that stand word by word elsewhere, by FM-indexes over shards of passages.

A window is ``width`` consecutive words. Among its word 8-grams the one of the smallest hash, the leftmost
of equals, is its anchor, so equal windows have equal anchors. Neighbouring windows of one anchor make
a run, and each window of a document is in one run. Only runs whose anchor another run has can hold a
repeated window; equal runs collapse to one content with a count, and only contents' words move, to the
shard of their anchor. A shard has an FM-index of its contents, streams them through it, and reports the
windows that the corpus holds twice or more.

Shards are bounded: an anchor with very many different contents, as a short common passage has, is dealt
out anew by whole windows, where equal ones collapse again and no key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FmIndex
from .shared import binary_column, discard, marks, mix, segments, sliced, table, tidy, word_hashes

WIDTH, GRAM = 35, 8
#: Different contents of one anchor that may meet in one shard, and words of one FM-index.
KINDS, SHARD = 1024, 400_000
#: Windows of a text that are looked at in one go.
STRETCH = 1 << 20


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each ``width`` neighbours, the leftmost of equals."""
    best, done = np.arange(len(values)), 1
    while done < width:
        step = min(done, width - done)
        left, right = best[: len(best) - step], best[step:]
        best, done = np.where(values[left] <= values[right], left, right), done + step
    return best


def _grams(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` neighbours, a power of two, by doubling."""
    out, done = mix(words), 1
    while done < width:
        out = mix(out[: len(out) - done] * np.uint64(0x9E3779B97F4A7C15) + out[done:])
        done *= 2
    return out


def runs(words: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(anchors, starts, sizes)`` of the runs of a text's windows, a stretch of the text at a time; sizes are in windows."""
    out, gram = [], GRAM
    while gram > width:
        gram //= 2
    for at in range(0, len(words) - width + 1, STRETCH):
        part = words[at : at + STRETCH + width - 1]
        grams = _grams(part, gram)
        places = _leftmost_least(grams, width - gram + 1)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(places)) + 1])
        out.append((grams[places[starts]], at + starts, np.diff(starts, append=len(places))))
    return out


def _digest(words: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(words.tobytes())


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and a number that routes a row; what tells rows apart is the digest of their words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    return docs.select(doc.alias("doc"), text.alias("text"), F.xxhash64(doc, text).alias("doc_id"))


_ROWS = "row long, doc long, doc_id long, digest binary, n_words long, anchors array<long>, contents array<long>, places array<long>"


def windowed(docs: DataFrame, width: int) -> DataFrame:
    """A row for each document: its runs' anchors, the hashes of their words, and ``start << 5 | windows - 1`` of each.

    A run has at most ``width - GRAM + 1`` windows, 28 of 35 words; wider windows are cut to runs of 32.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns: list[list] = [[], [], [], [], []]
            for text in binary_column(batch, "text"):
                words = word_hashes(text)
                whole = memoryview(words.tobytes())
                anchors, contents, places = [], [], []
                for anchor, starts, sizes in runs(words, width):
                    while sizes.max() > 32:
                        split = np.where(sizes > 32, 2, 1)
                        second = np.arange(split.sum()) - np.repeat(np.cumsum(split) - split, split)
                        anchor, starts, sizes = np.repeat(anchor, split), np.repeat(starts, split) + 32 * second, np.repeat(sizes, split)
                        more = np.repeat(split, split) == 2
                        sizes = np.where(more, np.where(second == 0, 32, sizes - 32), sizes)
                    anchors.append(anchor.view(np.int64))
                    ends = (starts + sizes + width - 1).tolist()
                    contents.append(np.fromiter((xxhash.xxh3_64_intdigest(whole[8 * a : 8 * b]) for a, b in zip(starts.tolist(), ends, strict=True)), np.uint64, len(ends)).view(np.int64))
                    places.append(starts << 5 | sizes - 1)
                none = np.empty(0, np.int64)
                for column, value in zip(columns, (_digest(words), len(words), *[np.concatenate(x) if x else none for x in (anchors, contents, places)]), strict=True):
                    column.append(value)
            longs = pa.list_(pa.int64())
            made = [pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), longs, longs, longs), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc"), batch.column("doc_id"), *made], ["row", "doc", "doc_id", "digest", "n_words", "anchors", "contents", "places"])

    return _keyed(docs).withColumn("row", F.monotonically_increasing_id()).mapInArrow(tidy(run), _ROWS)


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc, doc_id, text`` of the rows named in ``ids(doc_id)`` and of few others."""
    return marks(ids).split(_keyed(docs), True)


def _stretches(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``id, anchor, n, kinds, words``: the words of each content, from the text of the row that stands for it."""
    names = ["id", "anchor", "n", "kinds", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows: list[tuple] = []
            for text, digest, held in zip(binary_column(batch, "text"), batch.column("digest").to_pylist(), batch.column("held").to_pylist(), strict=True):
                words = word_hashes(text)
                if _digest(words) == digest:
                    for x in held:
                        at = x["place"] >> 5
                        rows.append((x["id"], x["anchor"], x["n"], x["kinds"], words[at : at + (x["place"] & 31) + width].tobytes()))
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], names)

    return _texts_of(docs, wanted.select("doc_id")).join(wanted, "doc_id").select("text", "digest", "held").mapInArrow(tidy(run), "id long, anchor long, n long, kinds long, words binary")


def _windows(stretches: DataFrame, width: int) -> DataFrame:
    """``a, b, id, j, n``: a 128-bit name for each window of each content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2000):
            names, ids, at, counts = [], [], [], []
            for i, n, words in zip(batch.column("id").to_pylist(), batch.column("n").to_pylist(), batch.column("words").to_pylist(), strict=True):
                m = len(words) // 8 - width + 1
                names += [xxhash.xxh3_128_digest(words[8 * j : 8 * (j + width)]) for j in range(m)]
                ids += [i] * m
                at += range(m)
                counts += [n] * m
            halves = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(counts, pa.int64())], ["a", "b", "id", "j", "n"])

    return stretches.mapInArrow(tidy(run), "a long, b long, id long, j long, n long")


def _single(stretches: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``id, anchor, n, words`` of single windows: those named in ``wanted(of, windows)``, cut from their contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2000):
            rows = [(x["id"], x["a"], x["n"], words[8 * x["j"] : 8 * (x["j"] + width)]) for words, held in zip(batch.column("words").to_pylist(), batch.column("windows").to_pylist(), strict=True) for x in held]
            kinds = [pa.int64()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)], ["id", "anchor", "n", "words"])

    return stretches.join(wanted, "id").select("words", "windows").mapInArrow(tidy(run), "id long, anchor long, n long, words binary")


def _searched(passages: DataFrame, width: int) -> DataFrame:
    """``level, id, mask``: bit j says that window j of the passage occurs twice or more. Each task makes FM-indexes
    of bounded size one after another, of whole anchors, and streams their passages through them."""
    columns = ["level", "id", "anchor", "n", "words"]

    def masks(rows: list[tuple]) -> pa.RecordBatch:
        rows = list({(level, i): (level, i, n, words) for level, i, _, n, words in rows}.values())  # repeated rows of the table give a passage twice
        sizes = np.array([len(words) // 8 for *_, words in rows], np.int64)
        flat = np.frombuffer(b"".join(words for *_, words in rows), np.uint64)
        found = FmIndex(flat, sizes, np.array([n for _, _, n, _ in rows], np.int64)).repeated(flat, sizes, width)
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(flat)) - np.repeat(starts, sizes)
        bits = np.add.reduceat(np.where(found, np.int64(1) << np.minimum(place, 62), 0), starts)
        kinds = [pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(([r[0] for r in rows], [r[1] for r in rows], bits), kinds, strict=True)], ["level", "id", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in columns], strict=True):
                if held > SHARD and row[2] != rows[-1][2]:
                    yield masks(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4]) // 8
        if rows:
            yield masks(rows)

    return passages.select(columns).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(tidy(run), "level int, id long, mask long")


def _covered(hits: DataFrame, width: int) -> DataFrame:
    """``row, n_removed, begins, ends``: stretches of words that repeated windows cover, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out: list[tuple] = []
            for held in batch.column("held").to_pylist():
                place = np.array([x["place"] >> 5 for x in held], np.int64)
                mask = np.array([x["mask"] for x in held], np.int64)
                which, j = np.nonzero(mask[:, None] >> np.arange(32)[None] & 1)
                starts = np.sort(place[which] + j)
                cut = np.flatnonzero(np.diff(starts) > width) + 1
                begins, ends = starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])] + width
                out.append((int((ends - begins).sum()), begins.tolist(), ends.tolist()))
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            made = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 3, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *made], ["row", "n_removed", "begins", "ends"])

    grouped = hits.groupBy("row").agg(F.collect_list(F.struct("place", "mask")).alias("held"))
    return grouped.mapInArrow(tidy(run), "row long, n_removed long, begins array<long>, ends array<long>")


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """``(rows, spans)``: tables of all documents' rows (``row, doc, doc_id, digest, n_words``, doc_id being a routing
    number) and of the covered stretches of those that have any (``row, n_removed, begins, ends``)."""
    rows = table(windowed(docs, width), "windowed")
    every = rows.select("row", F.inline(F.arrays_zip(F.col("anchors").alias("anchor"), F.col("contents").alias("content"), F.col("places").alias("place"))))
    # tables of their own: the joins with them then have nothing but their two sides, and Spark can split an anchor that very many runs have
    shared = table(every.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "shared")
    taken = table(every.join(shared, "anchor"), "taken")
    counted = table(taken.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("m")), "counted")
    kinds = table(counted.groupBy("anchor").agg(F.count("*").alias("kinds")), "kinds")
    contents = table(counted.join(kinds, "anchor").select(F.monotonically_increasing_id().alias("id"), "anchor", "content", "n", "kinds", "m.row", "m.place"), "contents")
    discard(shared, counted, kinds)
    wanted = contents.groupBy("row").agg(F.collect_list(F.struct("id", "anchor", "n", "kinds", "place")).alias("held"))
    wanted = table(wanted.join(rows.select("row", "doc_id", "digest"), "row").select("doc_id", "digest", "held"), "wanted")
    stretches = table(_stretches(docs, wanted, width), "stretches")

    hot = stretches.where(F.col("kinds") > KINDS).dropDuplicates(["id"])
    windows = table(_windows(hot, width), "windows")
    twice = windows.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min(F.struct("id", "j")).alias("m")).where("n > 1")
    twice = table(twice.select(F.monotonically_increasing_id().alias("window"), "a", "b", "n", F.col("m.id").alias("id"), F.col("m.j").alias("j")), "twice")
    cut = twice.groupBy("id").agg(F.collect_list(F.struct(F.col("window").alias("id"), "a", "n", "j")).alias("windows"))
    single = _single(hot, cut, width).withColumn("level", F.lit(2))
    plain = stretches.where(F.col("kinds") <= KINDS).withColumn("level", F.lit(1))
    passages = ["level", "id", "anchor", "n", "words"]
    found = table(_searched(plain.select(passages).unionByName(single.select(passages)), width).where("mask <> 0"), "found")

    again = twice.join(found.where("level = 2").select(F.col("id").alias("window")), "window", "left_semi").select("a", "b")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("j").cast("int"))
    of_hot = windows.join(again, ["a", "b"]).groupBy("id").agg(F.bit_or(bit).alias("mask"))
    of_all = found.where("level = 1").select("id", "mask").unionByName(of_hot)
    masks = table(contents.join(of_all, "id").select("anchor", "content", "mask"), "masks")
    spans = table(_covered(taken.join(masks, ["anchor", "content"]).select("row", "place", "mask"), width), "spans")
    rows = rows.select("row", "doc", "doc_id", "digest", "n_words")
    discard(taken, contents, wanted, stretches, windows, twice, found, masks)
    return rows, spans


def _kept_text(text: bytes, begins: list[int], ends: list[int]) -> tuple[int, bytes]:
    """Number of words, and those outside the stretches joined by single spaces."""
    out, at, i = [], 0, 0
    for part in segments(text):
        words = part.split()
        if begins:
            stay: list[bytes] = []
            low = at
            while i < len(begins) and begins[i] < at + len(words):
                stay += words[max(0, low - at) : max(0, begins[i] - at)]
                low = ends[i]
                if ends[i] > at + len(words):
                    break
                i += 1
            out.append(b" ".join(stay + words[max(0, low - at) :]))
        else:
            out.append(b" ".join(words))
        at += len(words)
    return at, b" ".join(x for x in out if x)


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_removed, text``: each text without the words that a window which also starts elsewhere
    covers, its own document included; words are joined by single spaces.

    All copies lose a passage, none is spared as the first. Windows are judged on the input. Null, empty and
    blank texts have no words, and texts shorter than a window lose none. Repeated rows are copies of each
    other, and so are rows without a doc_id; each gives a row. Very long texts go through in stretches of windows.
    Extra columns are ignored; an empty table gives no rows.

    Texts without a repeated window are worked on where they lie, texts of nothing else need not be read again;
    of the others, and few more, the text meets its stretches by key.
    """
    rows, spans = repeated_spans(docs, width)
    touched = table(rows.join(spans, "row"), "touched")
    whole = touched.where("n_removed = n_words").select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.lit("").alias("text"))
    named = marks(touched.select("doc_id"))
    key = ["doc_id", "digest"]
    partly = touched.where("n_removed < n_words").select(*key, "begins", "ends").dropDuplicates(key)
    none = F.array().cast("array<long>")
    others = named.split(rows.select(*key), True).join(touched.select(*key), key, "left_anti").distinct().select(*key, none.alias("begins"), none.alias("ends"))
    needed = table(partly.unionByName(others), "needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("doc", "digest", "begins", "ends")]
            for text, doc, digest, begins, ends in zip(binary_column(batch, "text"), *columns, strict=True):
                if digest is None or _digest(word_hashes(text)) == digest:
                    n, kept = _kept_text(text, begins, ends)
                    out.append((doc, n, sum(ends) - sum(begins), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            made = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*made[:3], made[3].cast(pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    schema = "doc_id long, n_words long, n_removed long, text string"
    apart = named.split(_keyed(docs), False).select("doc", "text", F.lit(None).cast("binary").alias("digest"), none.alias("begins"), none.alias("ends"))
    met = marks(needed.select("doc_id")).split(named.split(_keyed(docs), True), True).join(needed, "doc_id").select("doc", "text", *key[1:], "begins", "ends")
    return whole.unionByName(apart.mapInArrow(tidy(run), schema)).unionByName(met.mapInArrow(tidy(run), schema))


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def oracle_sql(width: int = WIDTH) -> str:
    """The query's rows as DuckDB SQL over all windows as strings."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
n AS (SELECT r, unnest(range(1, len(w) - {width - 2})) AS p, unnest(list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' '))) AS window_ FROM d WHERE len(w) >= {width}),
t AS (SELECT window_ FROM n GROUP BY window_ HAVING count(*) > 1),
h AS (SELECT r, p FROM n SEMI JOIN t USING (window_)),
c AS (SELECT s.r, s.p, s.word, count(h.p) OVER (PARTITION BY s.r ORDER BY s.p ROWS {width - 1} PRECEDING) > 0 AS gone FROM s LEFT JOIN h ON h.r = s.r AND h.p = s.p),
k AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
