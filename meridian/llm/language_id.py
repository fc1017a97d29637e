"""Language of texts and of their spans.

A word's script leaves only the languages that use it; hashed character n-grams score these; and a
Viterbi pass over the words, with a penalty for each switch, labels spans of one language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import sliced, texts, tidy

BUCKETS, SMOOTHING = 1 << 16, 0.5
#: The bound of the training sample: rows, and code points of a row that may be in it.
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 50_000
SWITCH_PENALTY, SCRIPT_SHARE, EXCLUDED = 8.0, 0.005, -1e4
#: Code points labelled at a time; a longer text goes through in stretches of about so many.
SLAB = 1 << 20

#: First and last code points of scripts.
SCRIPTS = {
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
}
N_SCRIPTS = len(SCRIPTS) + 2


@lru_cache(1)
def script_of() -> np.ndarray:
    """For every code point 0 where it is no letter, else its script's number; letters elsewhere are 1."""
    letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    out = np.ones(0x110000, np.uint8)
    for i, ranges in enumerate(SCRIPTS.values()):
        for first, last in ranges:
            out[first : last + 1] = i + 2
    return out * letters


@dataclass
class Words:
    """Features of a run of code points: words, the buckets of each letter, and each letter's word."""

    first: np.ndarray
    size: np.ndarray
    script: np.ndarray
    two: np.ndarray
    three: np.ndarray
    start: np.ndarray


def words_of(codes: np.ndarray) -> Words:
    scripts = script_of()[codes]
    letter = scripts > 0
    edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = end - first
    at = np.flatnonzero(letter)
    padded = np.zeros(len(codes) + 2, np.uint32)
    padded[1:-1] = np.where(letter, codes, 0)
    before, own, after = padded[at], padded[at + 1], padded[at + 2]
    two = before * np.uint32(0x9E3779B1) ^ own * np.uint32(0x85EBCA6B)
    three = two * np.uint32(0xC2B2AE35) ^ after * np.uint32(0x27D4EB2F)
    shift = np.uint32(16)
    start = np.cumsum(size) - size
    return Words(first, size, scripts[first], ((two * np.uint32(0x2C1B3C6D)) >> shift), ((three * np.uint32(0x2C1B3C6D)) >> shift), start)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")


@dataclass
class Model:
    langs: list[str]
    two: np.ndarray  # language, bucket
    three: np.ndarray
    script: np.ndarray  # script, language: 0 or EXCLUDED

    def scores(self, words: Words) -> np.ndarray:
        """word, language"""
        out = np.empty((len(words.first), len(self.langs)), np.float32)
        for k in range(len(self.langs)):
            out[:, k] = np.add.reduceat(self.two[k][words.two] + self.three[k][words.three], words.start) if len(words.start) else 0
        return out + self.script[words.script]


def fit(pairs: list[tuple[str, str]]) -> Model:
    """Smoothed n-gram log probabilities of each language; a script's languages are those that have a share of their own letters in it; all, if none has."""
    langs = sorted({lang for _, lang in pairs})
    two, three = np.zeros((2, len(langs), BUCKETS))
    used = np.zeros((N_SCRIPTS, len(langs)))
    for text, lang in pairs:
        k, words = langs.index(lang), words_of(codes_of(text))
        two[k] += np.bincount(words.two, minlength=BUCKETS)
        three[k] += np.bincount(words.three, minlength=BUCKETS)
        used[:, k] += np.bincount(words.script, words.size, N_SCRIPTS)
    logs = [np.log((x + SMOOTHING) / (x.sum(1, keepdims=True) + SMOOTHING * BUCKETS)).astype(np.float32) for x in (two, three)]
    share = used / np.maximum(1, used.sum(0, keepdims=True))
    allowed = share >= SCRIPT_SHARE
    allowed |= ~allowed.any(1, keepdims=True)
    return Model(langs, *logs, np.where(allowed, 0, EXCLUDED).astype(np.float32))


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best language of every word, for many texts at once; ties go to staying, then to the first language.

    ``scores`` has the words of all texts, one text after another, ``lengths`` how many each has.
    Texts take part longest first, so at step t those with more than t words are the leading ones.
    """
    total, k = scores.shape
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    begin = (np.cumsum(lengths) - lengths)[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts with more than t words
    switched = np.zeros((total, k), bool)
    source = np.zeros(total, np.uint8 if k < 256 else np.int32)
    value = np.zeros((len(sizes), k), np.float64)
    for t in range(longest):
        m = active[t]
        at = begin[:m] + t
        now = value[:m]
        if t:
            best = now.argmax(1)
            move = now[np.arange(m), best] - penalty
            hop = move[:, None] > now
            switched[at], source[at] = hop, best
            now = np.where(hop, move[:, None], now)
        value[:m] = now + scores[at]
    out = np.zeros(total, np.int64)
    state = value.argmax(1)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        out[at] = state[:m]
        if t:
            state[:m] = np.where(switched[at, state[:m]], source[at], state[:m])
    return out


class Path:
    """The best labels of a text's words, stretch by stretch: values go forward from one to the next, and a bit for
    each word and language, and the best language before each word, stay for the way back."""

    def __init__(self, langs: int, penalty: float = SWITCH_PENALTY) -> None:
        self.penalty, self.value = penalty, np.zeros(langs, np.float64)
        self.started = False
        self.switched: list[np.ndarray] = []
        self.source: list[np.ndarray] = []

    def add(self, scores: np.ndarray) -> None:
        n, k = scores.shape
        switched, source = np.zeros((n, k), bool), np.zeros(n, np.int32)
        value = self.value
        for t, own in enumerate(scores.astype(np.float64)):
            if self.started:
                best = value.argmax()
                move = value[best] - self.penalty
                hop = move > value
                switched[t], source[t] = hop, best
                value = np.where(hop, move, value)
            value = value + own
            self.started = True
        self.value = value
        self.switched.append(np.packbits(switched, axis=1))
        self.source.append(source.astype(np.uint8 if k < 256 else np.int32))

    def labels(self) -> list[np.ndarray]:
        """One array for each stretch."""
        k = len(self.value)
        state, out = int(self.value.argmax()), []
        for packed, source in zip(reversed(self.switched), reversed(self.source), strict=True):
            switched = np.unpackbits(packed, axis=1, count=k).astype(bool)
            own = np.empty(len(source), np.int64)
            for t in range(len(source) - 1, -1, -1):
                own[t] = state
                if switched[t, state]:
                    state = int(source[t])
            out.append(own)
        return out[::-1]


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def quotas(counts: dict[str, int], rows: int) -> dict[str, int]:
    """At most ``rows`` in all, dealt evenly; what a language does not have goes to the others."""
    out, left = {}, rows
    for i, lang in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        out[lang] = min(counts[lang], left // (len(counts) - i))
        left -= out[lang]
    return out


def _rows(docs: DataFrame, columns: dict[str, list]) -> DataFrame:
    return docs.sparkSession.createDataFrame(pa.table(columns))


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """At most ``rows`` documents of a known language outside the held-out fifth: of each language as many, the first in hash order.

    Of a document's several languages, and of its texts in that language, the one that sorts first
    counts, so the sample does not depend on partitions.
    """
    usable = texts(docs, "lang").where(F.col("lang").isNotNull() & ~held_out() & (F.length("text") <= chars) & (F.col("text") != ""))
    # as many languages as ``rows`` at most; a hash bound for each lets about twice its share and a few more through
    sizes = usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()
    if not sizes:
        return []
    share = quotas({r["lang"]: r["n"] for r in sizes}, rows)
    bounds = [(r["lang"], min((1 << 63) - 1, int((2 * share[r["lang"]] + 50) / max(1, r["n"]) * (1 << 64)) - (1 << 63))) for r in sizes]
    bounded = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).join(F.broadcast(_rows(docs, {"lang": [x for x, _ in bounds], "most": [x for _, x in bounds]})), "lang")
    passing: dict[str, list[int]] = {}
    met: set[int] = set()
    for r in sorted(bounded.where("h <= most").select("h", "doc_id", "lang").distinct().collect()):
        if r["doc_id"] not in met:
            met.add(r["doc_id"])
            passing.setdefault(r["lang"], []).append(r["doc_id"])
    share = quotas({lang: len(ids) for lang, ids in passing.items()}, rows)
    chosen = {i: lang for lang in sorted(passing) for i in passing[lang][: share[lang]]}
    if not chosen:
        return []
    # as many ids as ``rows`` at most
    ids = _rows(docs, {"doc_id": list(chosen), "lang": list(chosen.values())})
    found = usable.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    return [(r["text"], chosen[r["doc_id"]]) for r in sorted(found, key=lambda r: r["doc_id"])]


def _groups(texts_: list[str]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, text in enumerate(texts_):
        if size and size + len(text) > SLAB:
            yield at, i
            at, size = i, 0
        size += len(text) + 1
    if at < len(texts_):
        yield at, len(texts_)


Labelled = tuple[str, float, list[tuple[int, int, str]]]


def _labelled(model: Model, own: np.ndarray, first: np.ndarray, size: np.ndarray) -> Labelled:
    """What a text's word labels, starts and lengths say."""
    if not len(own) or not model.langs:
        return "und", 0.0, []
    letters = np.bincount(own, size, len(model.langs))
    best = int(letters.argmax())
    change = np.flatnonzero(np.diff(own)) + 1
    heads, tails = np.concatenate([[0], change]), np.concatenate([change, [len(own)]]) - 1
    spans = [(int(first[h]), int(first[t] + size[t]), model.langs[own[h]]) for h, t in zip(heads, tails, strict=True)]
    return model.langs[best], float(letters[best] / letters.sum()), spans


def _stretches(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Stretches of about SLAB code points, cut where no word is, with their places. A longer word is in one."""
    at = 0
    while at < len(codes):
        end = min(at + SLAB, len(codes))
        while end < len(codes):
            gaps = np.flatnonzero(script_of()[codes[end : end + 4096]] == 0)
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(end + 4096, len(codes))
        yield at, codes[at:end]
        at = end


def label_long(model: Model, text: str) -> Labelled:
    """One text in stretches: the same as in one piece, with memory for a few numbers a word besides the text."""
    path, firsts, sizes = Path(len(model.langs)), [], []
    for at, codes in _stretches(codes_of(text)):
        words = words_of(codes)
        path.add(model.scores(words))
        firsts.append(words.first + at)
        sizes.append(words.size)
    return _labelled(model, np.concatenate([np.empty(0, np.int64), *path.labels()]), np.concatenate([np.empty(0, np.int64), *firsts]), np.concatenate([np.empty(0, np.int64), *sizes]))


def label_texts(model: Model, texts_: list[str]) -> Iterator[Labelled]:
    """Language, its share of the letters, and spans ``(first word's start, last word's end, language)`` of each text."""
    gap = np.zeros(1, np.uint32)
    for a, b in _groups(texts_):
        if len(texts_[a]) > SLAB:
            yield label_long(model, texts_[a]) if model.langs else ("und", 0.0, [])
            continue
        part = [codes_of(t) for t in texts_[a:b]]
        words = words_of(np.concatenate([x for codes in part for x in (codes, gap)]))
        ends = np.cumsum([len(c) + 1 for c in part])
        count = np.searchsorted(words.first, ends)
        lengths = np.diff(count, prepend=0)
        labels = viterbi(model.scores(words), lengths) if model.langs else np.zeros(len(words.first), np.int64)
        for i, (low, high) in enumerate(zip([0, *count[:-1]], count, strict=True)):
            base = ends[i] - len(part[i]) - 1
            yield _labelled(model, labels[low:high], words.first[low:high] - base, words.size[low:high])


def identify(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score, spans``.

    lang_pred is the language of most letters, score its share of them. Texts that are null or
    without a letter are ``und`` with score 0; so is every text where no language was learned. Spans
    count code points of the lower-cased text. A very long text goes through in stretches with the same
    result. Ties go to staying in a language, then to the first by name. Repeated rows each get a row;
    extra columns are ignored; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, rows, chars)))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced([batch]):
                langs, scores, spans = [], [], []
                for lang, score, own in label_texts(model.value, part.column("text").to_pylist()):
                    langs.append(lang)
                    scores.append(score)
                    spans.append([{"start": a, "end": b, "lang": x} for a, b, x in own])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, span)], ["doc_id", "lang_pred", "score", "spans"])

    found = texts(docs).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")
