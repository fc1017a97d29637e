"""SentencePiece segmentation as a parallel max-plus scan.

The best-scoring segmentation of a text into the pieces of a SentencePiece model is a path over its
character positions. A giant text is cut into chunks of equal length; a chunk's transfer matrix has
the best score from every place where a piece may reach into it to every place where one may reach
out. Matrices combine associatively, first in groups of bounded size and then over the groups, which
fixes the states at all boundaries; every chunk is then backtraced by itself.

Equal scores are told apart by a second sum over the inner boundaries of a word, so that chunked and
plain segmentation agree. Characters without a piece become their bytes.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WordTable, sliced, table, texts, tidy

SPACE = "▁"
#: Code points of a chunk, texts over twice that are chunked, chunks that one task combines.
CHUNK, GROUP = 16384, 256
_UNKNOWN_PENALTY, _SCALE, _SHIFT = 10.0, 1 << 16, 64
_GROUP = 1 << 20
#: Code points of a word that is segmented together with others, and about how many bytes of words go together.
_SHORT, _SLICE = 64, 1 << 17
#: Fewer words than this go one by one.
_FEW = 16
_loaded: dict[str, Model] = {}


def _tie(at: int) -> int:
    """A number for a boundary ``at`` characters into a word."""
    return ((at * at * 0x9E3779B1 + at * 0x85EBCA6B) >> 7) & 0xFFFFF


_TIES = [_tie(i) for i in range(256)]
_LOW = float("-inf")


class Model:
    """Pieces and scores of a model file, as a lattice scorer. Weights are whole numbers: the scaled
    score above 64 bits of tie-breaking sum. What words gave is kept in a table of bounded size."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        size = processor.get_piece_size()
        self.bytes_of: list[bytes] = []
        self.pieces: dict[str, tuple[int, int]] = {}
        byte_ids = {}
        scores = []
        for i in range(size):
            piece = processor.id_to_piece(i)
            if processor.is_byte(i):
                byte_ids[int(piece[3:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:-1], 16)]))
            elif processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i):
                self.bytes_of.append(b"")
            else:
                scores.append(processor.get_score(i))
                self.pieces[piece] = (i, round(scores[-1] * _SCALE))
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        self.byte_ids = [byte_ids.get(b, processor.unk_id()) for b in range(256)]
        self.unknown = round((min(scores) - _UNKNOWN_PENALTY) * _SCALE)
        self.longest = max(map(len, self.pieces))
        #: A piece's scaled score; False for what only begins pieces.
        self.nodes: dict[str, int | bool] = {p[:i]: False for p in self.pieces for i in range(1, len(p) + 1)}
        self.nodes |= {p: w for p, (_, w) in self.pieces.items()}
        inside = {c for p in self.pieces if len(p) > 1 for c in p}
        if "\n" in inside or any(SPACE in p[1:] and p.strip(SPACE) for p in self.pieces):
            raise ValueError("pieces run across words or lines")
        self._grow()
        self.cache = WordTable()

    def _grow(self) -> None:
        """The pieces as a tree of UTF-8 bytes with a space for the mark: what begins longer pieces has a row of children."""
        spelled = {p.replace(SPACE, " ").encode(): (len(p), *found) for p, found in self.pieces.items() if " " not in p}
        inner = sorted({p[:i] for p in spelled for i in range(len(p))})
        number = {p: i for i, p in enumerate(inner)}
        for p in spelled:
            number.setdefault(p, len(number))
        self.children = np.full((max(1, len(inner)), 256), -1, np.int32)
        for p, i in number.items():
            if p:
                self.children[number[p[:-1]], p[-1]] = i
        #: By node, and last for a character without a piece: code points (0: no piece ends here), id and scaled score.
        self.node_chars, self.node_ids, self.node_scores = (np.zeros(len(number) + 1, kind) for kind in (np.int64, np.uint32, np.int64))
        for p, (chars, own, score) in spelled.items():
            i = number[p]
            self.node_chars[i], self.node_ids[i], self.node_scores[i] = chars, own, score
        self.node_chars[-1], self.node_scores[-1] = 1, self.unknown

    def step(self, s: str, i: int, stop: int) -> list[tuple[int, int]]:
        """``(end, weight)`` of the pieces that start at ``i`` and end by ``stop``."""
        out, single = [], False
        for j in range(i + 1, min(stop, i + self.longest) + 1):
            w = self.nodes.get(s[i:j])
            if w is None:
                break
            if w is not False:
                out.append((j, w << _SHIFT))
                single |= j == i + 1
        if not single:
            out.append((i + 1, self.unknown << _SHIFT))
        return out

    def ids_of(self, part: str) -> list[int]:
        found = self.pieces.get(part)
        return [found[0]] if found else [self.byte_ids[b] for b in part.encode()]

    def _word(self, s: str) -> tuple[bytes, int]:
        """Ids and weight of a stretch without a cut inside."""
        n, get, longest, unknown = len(s), self.nodes.get, self.longest, self.unknown
        tie = _TIES if n < len(_TIES) else [_tie(i) for i in range(n + 1)]
        best: list = [_LOW] * (n + 1)
        ties, back = [0] * (n + 1), [0] * (n + 1)
        best[0] = 0
        for i in range(n):
            b, t = best[i], ties[i]
            w = get(s[i])
            j = i + 1
            v = b + (unknown if w is None or w is False else w)
            if v > best[j] or v == best[j] and t + tie[j] > ties[j]:
                best[j], ties[j], back[j] = v, t + tie[j], i
            if w is None:
                continue
            for j in range(i + 2, min(n, i + longest) + 1):
                w = get(s[i:j])
                if w:
                    v = b + w
                    if v > best[j] or v == best[j] and t + tie[j] > ties[j]:
                        best[j], ties[j], back[j] = v, t + tie[j], i
                elif w is None:
                    break
                elif w == 0 and w is not False:
                    if b > best[j] or b == best[j] and t + tie[j] > ties[j]:
                        best[j], ties[j], back[j] = b, t + tie[j], i
        ids: list[int] = []
        at = n
        parts = []
        while at:
            parts.append(s[back[at] : at])
            at = back[at]
        for part in reversed(parts):
            found = self.pieces.get(part)
            if found:
                ids.append(found[0])
            else:
                ids += self.ids_of(part)
        return array("I", ids).tobytes(), (best[n] << _SHIFT) + ties[n] - tie[n]  # the word's end has no part in the sum

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words with spaces for marks in a row, how many each has, and the words' scores; as ``_word`` has them."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        short = sizes <= _SHORT
        for i in np.flatnonzero(~short).tolist():
            short[i] = len(words[i].decode()) <= _SHORT
        if np.count_nonzero(short) < _FEW:
            short[:] = False
        together, alone = np.flatnonzero(short), np.flatnonzero(~short)
        parts = np.split(together, np.flatnonzero(np.diff(np.cumsum(sizes[together]) // _SLICE)) + 1) if len(together) else []
        found = [self._short([words[i] for i in part.tolist()]) for part in parts]
        for i in alone.tolist():
            ids, weight = self._word(words[i].decode().replace(" ", SPACE))
            found.append((np.frombuffer(ids, "<u4"), np.array([len(ids) // 4]), np.array([(weight >> _SHIFT) / _SCALE])))
        ids, counts, scores = (np.concatenate(c) for c in zip((np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0)), *found, strict=True))
        if len(alone) and len(together):  # back to the order of the words
            order = np.argsort(np.concatenate([together, alone]))
            places = (np.cumsum(counts) - counts)[order]
            counts, scores = counts[order], scores[order]
            ids = ids[np.repeat(places - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))]
        return ids, counts, scores

    def _short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``words`` for short ones: the lattices of all of them side by side, the k-th code points of all at a time.

        A word of n code points has n + 1 points; an edge is a piece, or a character without one, from point to point.
        """
        codes = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        at = np.flatnonzero(codes & 0xC0 != 0x80)
        word = np.searchsorted(ends, at, "right")
        until = ends[word]
        chars = np.bincount(word, minlength=len(words))
        last = np.cumsum(chars + 1) - 1
        depth = np.arange(len(at)) - (np.cumsum(chars) - chars)[word]
        # what matches from each character on
        live, place, node = np.arange(len(at)), at, self.children[0, codes[at]]
        lives, nodes = [], []
        while len(live):
            live, place, node = (x[node >= 0] for x in (live, place, node))
            hit = self.node_chars[node] > 0
            lives.append(live[hit])
            nodes.append(node[hit])
            place = place + 1
            more = (node < len(self.children)) & (place < until[live])
            live, place = live[more], place[more]
            node = self.children[node[more], codes[place]]
        live, node = np.concatenate(lives), np.concatenate(nodes)
        single = np.zeros(len(at), bool)
        single[live[self.node_chars[node] == 1]] = True
        alone = np.flatnonzero(~single)
        live, node = np.concatenate([live, alone]), np.concatenate([node, np.full(len(alone), len(self.node_chars) - 1, node.dtype)])
        # edges by how far into their words they end, then by end, longest first
        long = self.node_chars[node]
        start = live + word[live]
        order = np.argsort((depth[live] + long << 48) + (start + long << 8) + (_SHORT - long))
        live, node, start, long = live[order], node[order], start[order], long[order]
        end, score = start + long, self.node_scores[node]
        first = np.flatnonzero(np.diff(end, prepend=-1))
        points, sizes = end[first], np.diff(first, append=len(end))
        best, ties, back = (np.zeros(last[-1] + 1, np.int64) for _ in range(3))
        groups = np.searchsorted((depth[live] + long)[first], np.arange(1, chars.max() + 2))
        for k, (a, b) in enumerate(zip(groups[:-1].tolist(), groups[1:].tolist(), strict=True), 1):
            lo, hi = first[a], first[b] if b < len(first) else len(end)
            begin = first[a:b] - lo
            value = best[start[lo:hi]] + score[lo:hi]
            top = np.maximum.reduceat(value, begin)
            tie = np.where(value == np.repeat(top, sizes[a:b]), ties[start[lo:hi]], -1)
            most = np.maximum.reduceat(tie, begin)
            won = np.flatnonzero(tie == np.repeat(most, sizes[a:b]))[::-1] + lo  # of equal ones the longest is written last
            best[points[a:b]], ties[points[a:b]], back[end[won]] = top, most + _TIES[k], won
        # an edge of a best path is the only one of them that leaves its point
        left, now = np.full(len(best), -1), last
        zero = last - chars
        while len(now):
            edge = back[now]
            now = start[edge]
            left[now] = edge
            more = now > zero
            now, zero = now[more], zero[more]
        path = left[left >= 0]
        live, node = live[path], node[path]
        lone = node == len(self.node_chars) - 1
        parts = np.where(lone, np.append(at[1:], len(codes))[live] - at[live], 1)
        ids = np.repeat(self.node_ids[node], parts)
        if lone.any():
            inside = np.repeat(at[live] - (np.cumsum(parts) - parts), parts) + np.arange(len(ids))
            ids = np.where(np.repeat(lone, parts), np.array(self.byte_ids, np.uint32)[codes[np.minimum(inside, len(codes) - 1)]], ids)
        return ids, np.bincount(word[live], parts, len(words)).astype(np.int64), best[last] / _SCALE

    def forward(self, s: str, entry: dict[int, int], limit: int, base: int, stop: int) -> tuple[dict[int, int], dict[int, int]]:
        """Best weights of positions from the ``entry`` ones on, expanding positions before ``limit``.

        ``base`` says how far into its word position 0 is.
        """
        best, back = dict(entry), {}
        word = -base
        for i in range(limit):
            if i and cut(s, i):
                word = i
            if i not in best:
                continue
            b = best[i]
            for j, w in self.step(s, i, stop):
                v = b + w + (0 if j == len(s) or cut(s, j) else _tie(j - word))
                if j not in best or v > best[j]:
                    best[j], back[j] = v, i
        return best, back

    def trace(self, s: str, back: dict[int, int], at: int) -> tuple[list[int], int]:
        """Ids of the best path to ``at``, and where it starts."""
        parts = []
        while at in back:
            parts.append(s[back[at] : at])
            at = back[at]
        return [i for p in reversed(parts) for i in self.ids_of(p)], at

    def encode(self, text: str) -> tuple[bytes, float]:
        """Ids as little-endian unsigned 32-bit numbers, and the score."""
        return self.encode_all([text])[0]

    def encode_all(self, texts_: list[str]) -> list[tuple[bytes, float]]:
        """All texts at once: their words are looked up together.

        A byte for the mark before the text and the line end after it makes every byte part of one
        word. Texts with runs of spaces or space marks of their own go word by word.
        """
        out: list = [None] * len(texts_)
        plain, held, size = [], [], 0
        for i, text in enumerate(texts_):
            if not text:
                out[i] = (b"", 0.0)
            elif text[0] == " " or "  " in text or SPACE in text:
                out[i] = self._by_words(prepared(text))
            else:
                plain.append(i)
                held.append(b" " + text.encode())
                size += len(held[-1])
            if plain and (size > _GROUP or i == len(texts_) - 1):
                for k, got in zip(plain, self._together(held), strict=True):
                    out[k] = got
                plain, held, size = [], [], 0
        if plain:
            for k, got in zip(plain, self._together(held), strict=True):
                out[k] = got
        return out

    def stretch(self, s: str) -> tuple[bytes, float]:
        """Ids and score of a prepared stretch that starts and ends at cuts."""
        if SPACE * 2 in s:
            return self._by_words(s)
        return self._together([s.replace(SPACE, " ").encode()])[0]

    def _by_words(self, s: str) -> tuple[bytes, float]:
        found = list(map(self._word, words_of(s)))
        return b"".join([f[0] for f in found]), sum([f[1] >> _SHIFT for f in found]) / _SCALE

    def _together(self, texts_: list[bytes]) -> list[tuple[bytes, float]]:
        data = b"\n".join(texts_) + b"\n"
        codes = np.frombuffer(data, np.uint8)
        line = codes == 10
        head = line | (codes == 32)
        head[1:] |= line[:-1]
        head[:1] = True
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:], len(codes))

        ids, sizes, scores = self.cache.look_up_rows(data, starts, ends, self.words)
        bounds = np.cumsum([len(t) + 1 for t in texts_])
        last = np.searchsorted(starts, bounds) - 1  # each text's added line end
        after = np.cumsum(sizes)
        first = np.concatenate([[0], last[:-1] + 1])
        begin, end = after[first] - sizes[first], after[last] - sizes[last]
        sums = [float(scores[a:b].sum()) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        return [(ids[a:b].tobytes(), x) for a, b, x in zip(begin.tolist(), end.tolist(), sums, strict=True)]

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return data.decode("utf-8", "replace").removeprefix(" ")

    # chunks: s starts at the chunk and goes on by as much as a piece may reach, and one more

    def anchors(self, s: str, size: int, base: int) -> tuple[int, int] | None:
        """The first cut that no piece from before the chunk reaches, and the chunk's last cut."""
        first = next((i for i in range(min(self.longest, size), size) if cut(s, i)), None)
        if first is None:
            return None
        return first, next(i for i in range(size - 1, first - 1, -1) if cut(s, i))

    def matrix(self, s: str, size: int, base: int) -> list[list[int | None]]:
        """``[entry][exit]``: the best weight from an offset into the chunk to one past its end."""
        width = self.longest
        marks = self.anchors(s, size, base)
        if marks is None:
            rows = []
            for a in range(width):
                best, _ = self.forward(s, {a: 0}, size, base, len(s))
                rows.append([best.get(size + b) for b in range(width)] if a <= size else [None] * width)
            return rows
        first, last = marks
        middle = round(self.stretch(s[first:last])[1] * _SCALE) << _SHIFT if last > first else 0
        best, _ = self.forward(s[last:], {0: 0}, size - last, 0, len(s) - last)
        ends = [best.get(size - last + b) for b in range(width)]
        rows = []
        for a in range(width):
            best, _ = self.forward(s[: first + 1], {a: 0}, first, base, first)
            head = best.get(first)
            rows.append([None if head is None or e is None else head + middle + e for e in ends])
        return rows

    def chunk_ids(self, s: str, size: int, base: int, entry: int, exit_: int) -> list[int]:
        marks = self.anchors(s, size, base)
        if marks is None:
            _, back = self.forward(s, {entry: 0}, size, base, len(s))
            return self.trace(s, back, size + exit_)[0]
        first, last = marks
        _, back = self.forward(s[: first + 1], {entry: 0}, first, base, first)
        ids = self.trace(s, back, first)[0]
        if last > first:
            ids += array("I", self.stretch(s[first:last])[0])
        _, back = self.forward(s[last:], {0: 0}, size - last, 0, len(s) - last)
        return ids + self.trace(s[last:], back, size - last + exit_)[0]


def model(path: str) -> Model:
    if path not in _loaded:
        _loaded[path] = Model(path)
    return _loaded[path]


def prepared(text: str) -> str:
    """Spaces become the space mark, and one goes before a text that is not empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def cut(s: str, i: int) -> bool:
    """No piece runs across position ``i``: a space mark follows another character, or a line end is next to it."""
    return s[i] == SPACE and s[i - 1] != SPACE or s[i] == "\n" or s[i - 1] == "\n"


def last_cut(s: str, at: int, low: int, before: int, cut: Callable[[str, int], bool] = cut) -> int:
    """The last cut up to ``at``, where ``before`` is the last one up to ``low``: nothing is looked at twice."""
    return next((i for i in range(at, low, -1) if cut(s, i)), before)


_WORDS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


def words_of(s: str) -> list[str]:
    """A text cut at all its cuts."""
    return _WORDS.findall(s)


def combine(a: list[list], b: list[list]) -> list[list]:
    """Max-plus product; None is minus infinity."""
    out = []
    for row in a:
        mine = [(i, x) for i, x in enumerate(row) if x is not None]
        out.append([max((x + b[i][j] for i, x in mine if b[i][j] is not None), default=None) for j in range(len(b[0]))])
    return out


def states(matrices: list[list[list]], entry: int, exit_: int) -> list[tuple[int, int]]:
    """Entry and exit state of every matrix in a chain on the best way from ``entry`` to ``exit_``."""
    fronts = [[0 if i == entry else None for i in range(len(matrices[0]))]]
    for m in matrices:
        fronts.append(combine([fronts[-1]], m)[0])
    out, at = [], exit_
    for front, m in zip(reversed(fronts[:-1]), reversed(matrices), strict=True):
        was = max((i for i, x in enumerate(front) if x is not None and m[i][at] is not None), key=lambda i: front[i] + m[i][at])
        out.append((was, at))
        at = was
    return out[::-1]


def _dump(m: list[list]) -> str:
    return ";".join(",".join("" if x is None else str(x) for x in row) for row in m)


def _load(text: str) -> list[list]:
    return [[int(x) if x else None for x in row.split(",")] for row in text.split(";")]


def _chunks(docs: DataFrame, path: str, chunk: int) -> DataFrame:
    """Chunks of giant texts under a number that is given to each row once, when the chunks are written; the first one of a
    text has its doc_id and digest too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for row, doc, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                s = prepared(text)
                rows = []
                head = (doc, hashlib.sha256(text.encode()).hexdigest())
                word = low = 0
                for k, at in enumerate(range(0, len(s), chunk)):
                    size = min(chunk, len(s) - at)
                    word, low = last_cut(s, at, low, word), at
                    part = s[at : at + size + own.longest + 1]
                    rows.append((row, k, k // GROUP, part, size, at - word, _dump(own.matrix(part, size, at - word)), *head))
                    head = (None, None)
                    if len(rows) == 64:
                        yield _chunk_batch(rows)
                        rows = []
                if rows:
                    yield _chunk_batch(rows)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return numbered.mapInArrow(tidy(run), "row long, k long, g long, part string, size int, base int, matrix string, doc_id long, text_sha256 string")


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string())
    names = ["row", "k", "g", "part", "size", "base", "matrix", "doc_id", "text_sha256"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _giant(docs: DataFrame, path: str, chunk: int) -> DataFrame:
    """``doc_id, text_sha256, ids, score, n_chunks`` of giant texts. Matrices meet by group, and then only states and scores,
    with the numbers of their row and chunk, meet the chunks' texts."""
    chunks = table(_chunks(docs, path, chunk), "chunks")

    def product(key, part: pd.DataFrame) -> pd.DataFrame:
        total = None
        for text in part.sort_values("k")["matrix"]:
            total = _load(text) if total is None else combine(total, _load(text))
        return pd.DataFrame({"row": [key[0]], "g": [key[1]], "matrix": [_dump(total)]})

    def outer(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("g")
        found = states([_load(m) for m in part["matrix"]], 0, 0)
        return pd.DataFrame({"row": key[0], "g": part["g"].to_numpy(), "entry": [a for a, _ in found], "exit": [b for _, b in found]})

    def inner(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k")
        found = states([_load(m) for m in part["matrix"]], int(part["entry"].iloc[0]), int(part["exit"].iloc[0]))
        scores = [(_load(m)[a][b] >> _SHIFT) / _SCALE for m, (a, b) in zip(part["matrix"], found, strict=True)]
        return pd.DataFrame({"row": key[0], "k": part["k"].to_numpy(), "entry": [a for a, _ in found], "exit": [b for _, b in found], "score": scores})

    narrow = chunks.select("row", "g", "k", "matrix")
    groups = narrow.groupBy("row", "g").applyInPandas(product, "row long, g long, matrix string")
    ends = groups.groupBy("row").applyInPandas(outer, "row long, g long, entry int, exit int")
    fixed = narrow.join(ends, ["row", "g"]).groupBy("row", "g").applyInPandas(inner, "row long, k long, entry int, exit int, score double")

    def backtrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            ids = [np.array(own.chunk_ids(*one), "<u4").tobytes() for one in zip(*(batch.column(n).to_pylist() for n in ("part", "size", "base", "entry", "exit")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array(ids, pa.binary()), batch.column("score")], ["row", "k", "ids", "score"])

    # the same join at every size: no part of the result or of the plan hangs on what Spark would broadcast
    met = chunks.select("row", "k", "part", "size", "base").join(fixed.hint("merge"), ["row", "k"])
    traced = met.mapInArrow(tidy(backtrace), "row long, k long, ids binary, score double")
    listed = traced.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"), F.sum("score").alias("score"), F.count("*").alias("n_chunks"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [b"".join(p["ids"] for p in parts) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(ids, pa.binary()), batch.column("score"), batch.column("n_chunks")], ["row", "ids", "score", "n_chunks"])

    heads = chunks.where("k = 0").select("row", "doc_id", "text_sha256")
    return heads.join(listed.mapInArrow(tidy(joined), "row long, ids binary, score double, n_chunks long"), "row").drop("row")


def encode(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, text_sha256, ids, score, n_chunks``: ids as little-endian unsigned 32-bit numbers.

    Null and empty texts have no ids and score 0. Repeated rows each get a row. Extra columns are
    ignored. Texts of up to two chunks are done whole, in their own task.
    """
    every = texts(docs)
    large = F.length("text") > 2 * chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in sliced(batches, 64):
            values = batch.column("text").to_pylist()
            ids, scores = zip(*own.encode_all(values), strict=True) if values else ((), ())
            shas = [hashlib.sha256(text.encode()).hexdigest() for text in values]
            columns = [batch.column("doc_id"), pa.array(shas, pa.string()), pa.array(ids, pa.binary()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_sha256", "ids", "score"])

    small = every.where(~large).mapInArrow(tidy(whole), "doc_id long, text_sha256 string, ids binary, score double")
    return small.withColumn("n_chunks", F.lit(1).cast("long")).unionByName(_giant(every.where(large), path, chunk))



def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``text`` rebuilt from ``ids``. The text is the original one, but that a space mark
    in it comes back as a space. No ids give an empty text, null ids a null one; very long lists are joined
    in one pass; repeated rows each get theirs; other columns stay, but a ``text`` there is replaced; an
    empty table gives no rows."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        own = model(path)
        return ids.map(lambda x: None if x is None else own.decode(np.frombuffer(x, "<u4").tolist()))

    return encoded.withColumn("text", text("ids"))


def round_trip(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_pieces, score, n_chunks, ids_crc32, text_sha256, decoded_sha256, same`` of every document.

    Null and empty texts have no pieces and are the same; texts over two chunks go through the scan;
    repeated rows and rows without a doc_id each get a row; extra columns are ignored; an empty table gives
    no rows. same is false only for a text that has a space mark itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in sliced(batches):
            rows = []
            for ids, sha in zip(batch.column("ids").to_pylist(), batch.column("text_sha256").to_pylist(), strict=True):
                again = hashlib.sha256(own.decode(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest()
                rows.append((len(ids) // 4, zlib.crc32(ids), again, again == sha))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
            n, crc, again, same = (pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True))
            columns = [batch.column("doc_id"), n, batch.column("score"), batch.column("n_chunks"), crc, batch.column("text_sha256"), again, same]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "score", "n_chunks", "ids_crc32", "text_sha256", "decoded_sha256", "same"])

    schema = "doc_id long, n_pieces long, score double, n_chunks long, ids_crc32 long, text_sha256 string, decoded_sha256 string, same boolean"
    return encode(docs, path, chunk).mapInArrow(tidy(run), schema)
