"""Best-fit-decreasing sequence packing with certified bin counts.

Texts become token ids once; pieces of a fixed length are cut only from documents longer than a
sequence. Pieces are dealt to partitions of bounded size and packed there by best-fit decreasing.
Lower bounds from dual feasible functions then decide: a partition that needs as many bins as its bound
says is certified and left alone; one with a gap gives its emptiest bins, one more than the gap, to an
exchange, where the pieces of many partitions are packed anew. Rounds go on as long as they save bins.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WordTable, binary_column, segments, sliced, table, texts, tidy, words_in

CAPACITY = 4096
#: Pieces dealt to a partition, or to a pool of an exchange.
PER_PARTITION = 16384
#: Least filled bins of each partition that take part in exchanges of rounding, round by round, and the bins of which
#: a round must save one at least for another to follow.
SPARE, WORTH = (1, 2, 4, 8, 16, 32, 64), 1 << 14
#: Bytes looked up at a time.
_GROUP = 1 << 20
END_OF_WORD = b"\xff"
_loaded: dict[str, _State] = {}


class _State:
    """A worker's tokenizer and the ids of words it met."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.piece = _plain_words(path)
        self.cache = WordTable()

    def ids(self, texts_: list[bytes]) -> list[bytes]:
        """Ids of texts; A-Z are lowered before, except in texts where a marker could come of it."""
        data = b" ".join([t if b"<|" in t else t.lower() for t in texts_])
        starts, ends = words_in(data)
        out, sizes, _ = self.cache.look_up(data, starts, ends, lambda new: [(ids, 0.0) for ids in self.encode_words(new)])
        bounds = np.cumsum([len(t) + 1 for t in texts_])
        cut = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, bounds)].tolist()
        return [out[a:b].tobytes() for a, b in zip([0, *cut], cut)]  # noqa: B905

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        out: list = [self.plain(w) if len(w) < 100 else None for w in words]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for at in range(0, len(rest), 8192):
            part = rest[at : at + 8192]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([words[i].decode() for i in part], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def plain(self, word: bytes) -> list[int] | None:
        """Ids of a lower-case Latin word, with at most one full stop or comma after it."""
        text = word.decode()
        tail = text[-1:] if text[-1:] in (".", ",") else ""
        core = text[:-1] if tail else text
        if not core.isalpha() or core.lower() != core or not core.isascii() and (max(core) >= "\u0250" or not unicodedata.is_normalized("NFC", core)):
            return None
        ids = self.piece(core.encode() + END_OF_WORD)
        return ids + self.piece(tail.encode() + END_OF_WORD) if tail else ids


def _plain_words(path: str):
    """A faster encoder of single words by the vocabulary's own merges.

    The vocabulary marks a word's end by a suffix. Written as a byte that no UTF-8 text has, the
    suffix becomes part of ordinary byte pairs, and the ids are already the order of the merges:
    first bytes, then bytes at a word's end, then the merged pairs.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {}
    for token, i in vocabulary.items():
        if not re.fullmatch(r"<\|\w+\|>", token):
            ends = token.endswith("</w>")
            ranks[bytes(byte_of[c] for c in (token[:-4] if ends else token)) + END_OF_WORD * ends] = i
    return tiktoken.Encoding("words", pat_str=r"[^\n]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


def _tokenizer(path: str) -> _State:
    if path not in _loaded:
        _loaded[path] = _State(path)
    return _loaded[path]


def encode(texts_: list[bytes], path: str) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers.

    The vocabulary's rules drop white space and never look across it, so a text's ids are those of
    its words, one after another. They also lower-case, so A-Z may be lowered before, except where a
    marker of the vocabulary, which starts with ``<|``, could be made so.
    """
    state = _tokenizer(path)
    parts = [(i, part) for i, text in enumerate(texts_) for part in (segments(text, _GROUP) if len(text) > _GROUP else [text])]
    at, held, owner = 0, [], 0
    while at < len(parts):
        end, size = at, 0
        while end < len(parts) and (end == at or size + len(parts[end][1]) <= _GROUP):
            size += len(parts[end][1])
            end += 1
        for (i, _), ids in zip(parts[at:end], state.ids([p for _, p in parts[at:end]]), strict=True):
            while owner < i:
                yield b"".join(held)
                held, owner = [], owner + 1
            held.append(ids)
        at = end
    while owner < len(texts_):
        yield b"".join(held)
        held, owner = [], owner + 1


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: a document's ids, then ``end_id``, cut at ``capacity``."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 512):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(binary_column(batch, "text"), tokenizer_path), strict=True):
                ids += end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, i, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of each item. Longest first (ties in the given order), each into the fullest bin that takes it.

    Bit r of a whole number is set while some bin has r tokens left, so the best bin is its lowest
    set bit from the item's length on.
    """
    out = np.empty(len(lengths), np.int64)
    left: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = left[r].pop()
            if not left[r]:
                mask ^= 1 << r
        else:
            r, b, bins = capacity, bins, bins + 1
        out[i] = b
        left[r - n].append(b)
        mask |= 1 << (r - n)
    return out


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing of these lengths needs."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1)[: capacity + 1], capacity)


def bound_of_counts(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """The bound from how many pieces there are of each length, by two families of dual feasible functions.

    One counts items over ``capacity - e`` as full, those under ``e`` as nothing and others as they
    are, for every e up to half; the other rounds ``(k + 1) * length / capacity`` down, for k to 32.
    """
    if not count.any():
        return 0
    size = np.arange(capacity + 1)
    number, total = np.cumsum(count), np.cumsum(count * size)
    e = np.arange(0, capacity // 2 + 1)
    large = number[-1] - number[capacity - e]
    below = np.where(e > 0, total[np.maximum(e - 1, 0)], 0)
    best = int((-(-(large * capacity + total[capacity - e] - below) // capacity)).max())
    for k in range(1, 33):
        scaled = (k + 1) * size
        # in units of 1 / (k * capacity), so that sums stay whole
        f = np.where(scaled % capacity == 0, k * size, scaled // capacity * capacity)
        best = max(best, -(-int((count * f).sum()) // (k * capacity)))
    return best


def _fill(part: pd.DataFrame) -> pd.Series:
    """Tokens in each bin, the emptiest first, ties by the bin's number."""
    return part.groupby("sequence_id")["length"].sum().sort_index().sort_values(kind="stable")


def packed_partition(part: pd.DataFrame, group: int, level: int, spare: int, capacity: int = CAPACITY) -> pd.DataFrame:
    """One partition or pool packed: ``sequence_id``, ``partition`` and ``open`` of its pieces.

    Level 0 packs anew; in an exchange the new packing counts only where it needs fewer bins than came
    in. With a gap between bins and bound, the emptiest bins are open for the next exchange, one more
    than the gap; without one, as many as ``spare`` says.
    """
    part = part.sort_values(["doc_id", "piece"], ignore_index=True)
    lengths = part["length"].to_numpy()
    numbers = best_fit_decreasing(lengths, capacity)
    before = part["sequence_id"].nunique() if level else None
    if before is None or numbers.max() + 1 < before:
        part = part.assign(sequence_id=(level << 56) + (group << 24) + numbers, partition=(level << 40) + group)
    fill = _fill(part)
    gap = len(fill) - lower_bound(lengths, capacity)
    return part.assign(open=part["sequence_id"].isin(fill.index[: gap + 1 if gap > 0 else spare]))


def _certified(part: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Places of a partition's pieces in their sequences, and the partition's certificate."""
    part = part.sort_values(["sequence_id", "length", "doc_id", "piece"], ascending=[True, False, True, True], ignore_index=True)
    bins, bound = part["sequence_id"].nunique(), lower_bound(part["length"].to_numpy(), capacity)
    offset = part.groupby("sequence_id")["length"].cumsum() - part["length"]
    return part.assign(offset=offset, bins=bins, bound=bound, certified=bins == bound)


def global_bound(cut: DataFrame, capacity: int = CAPACITY) -> int:
    """Bins that any packing of all pieces needs, from the counts of each length, at most ``capacity`` rows."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    return bound_of_counts(np.array([counts.get(i, 0) for i in range(capacity + 1)], np.int64), capacity)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id``, ``offset`` and the certificate ``partition, bins, bound, certified`` to pieces.

    A partition holds about ``PER_PARTITION`` pieces whatever their source, and so does a pool of an
    exchange, so no task grows with the input. Gaps are exchanged first. While all bins together are
    more than the bound of all pieces, what remains is rounding: of each partition the least filled bin
    takes part as well, then a few more, as ``SPARE`` says, as long as that saves bins. bins and bound are those of the partition that
    packed a piece's sequence; certified says that they are equal. Ties go by doc_id and piece. No pieces
    give no rows.
    """
    names = cut.columns
    # a column with nulls would reach pandas as floating point
    held = cut.withColumns({"no_id": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0).cast("long"))})
    schema = ", ".join(f"{n} {t}" for n, t in held.dtypes)
    fields = [*held.columns, "sequence_id", "partition"]
    level = 0

    def packed(held: DataFrame, spare: int) -> tuple[DataFrame, int]:
        """Pieces packed in partitions, and how many these are."""
        groups, at = max(1, -(-held.count() // PER_PARTITION)), level

        def one(key, part: pd.DataFrame) -> pd.DataFrame:
            return packed_partition(part, int(key[0]), at, spare, capacity)[[*fields, "open"]]

        # the pieces of a bin meet again in an exchange
        key = F.xxhash64("sequence_id", F.lit(at)) if at else F.xxhash64("doc_id", "piece")
        dealt = held.withColumn("group", F.pmod(key, F.lit(groups)))
        return table(dealt.groupBy("group").applyInPandas(one, f"{schema}, sequence_id long, partition long, open boolean"), "packed"), groups

    def exchanged(done: DataFrame, spare: int) -> DataFrame:
        """Open bins go through exchanges until no pool has a gap, one pool is left, or a round saves too little."""
        nonlocal level
        settled = None
        while True:
            rest = done.where("not open")
            settled = rest if settled is None else settled.unionByName(rest)
            moving = done.where("open").drop("open")
            before = _bins(moving)
            if not before:
                return settled.drop("open")
            level += 1
            done, groups = packed(moving, spare)
            if groups == 1 or before - _bins(done) < 1 + before // WORTH:
                return settled.unionByName(done).drop("open")

    none = F.lit(0).cast("long")
    kept = exchanged(packed(held.withColumns({"sequence_id": none, "partition": none}), 0)[0], 0)
    now, least = _bins(kept), global_bound(kept, capacity)
    for spare in SPARE:
        if now <= least:
            break
        filled = kept.withColumn("fill", F.sum("length").over(Window.partitionBy("partition", "sequence_id")))
        place = F.dense_rank().over(Window.partitionBy("partition").orderBy("fill", "sequence_id"))
        kept = exchanged(filled.select(*fields, (place <= spare).alias("open")), spare)
        before, now = now, _bins(kept)
        if before - now < 1 + now // WORTH:
            break
    out = kept.groupBy("partition").applyInPandas(lambda part: _certified(part, capacity), f"{schema}, sequence_id long, partition long, offset long, bins long, bound long, certified boolean")
    doc_id = F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id")
    return out.select(*[doc_id if n == "doc_id" else n for n in names], "sequence_id", "offset", "partition", "bins", "bound", "certified")


def _bins(done: DataFrame) -> int:
    return done.select("sequence_id").distinct().count()


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Pack whole documents: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, and the certificate of ``pack``.

    Null and empty texts are the end id alone. Repeated rows are packed as often as they occur.
    Extra columns are ignored. An empty table gives no rows.
    """
    return pack(table(pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
