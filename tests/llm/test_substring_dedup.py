import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from meridian.llm import substring_dedup as dup
from meridian.llm.fm_index import FmIndex, suffix_array
from meridian.llm.shared import word_hashes

from .conftest import prose


def expected(rows, width=35):
    """Every window as a tuple of words."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc is None, doc, len(w), len(gone), kept))
    return sorted(out)


def found(df, width=35):
    return sorted((r["doc_id"] is None, r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in dup.dedup(df, width).collect())


@pytest.mark.parametrize("seed", range(4))
def test_index_finds_what_the_definition_finds(seed):
    rng = np.random.default_rng(seed)
    for _ in range(10):
        sizes, few = rng.integers(1, 40, rng.integers(1, 14)), int(rng.integers(1, 4))
        flat, counts = rng.integers(0, few, sizes.sum()).astype(np.uint64), rng.integers(1, 3, len(sizes))
        index, width = FmIndex(flat, sizes, counts), int(rng.integers(1, 9))
        ends = np.cumsum(sizes)
        pieces = [flat[e - s : e].tolist() for s, e in zip(sizes, ends, strict=True)]
        seen = Counter()
        for piece, n in zip(pieces, counts.tolist(), strict=True):
            for i in range(len(piece) - width + 1):
                seen[tuple(piece[i : i + width])] += n
        want = [i + width <= len(piece) and seen[tuple(piece[i : i + width])] >= 2 for piece in pieces for i in range(len(piece))]
        assert index.repeated(flat, sizes, width).tolist() == want
        other = rng.integers(0, few + 2, 50).astype(np.uint64)  # a document of other words, streamed through the index
        got = index.repeated(other, np.array([50]), width)
        assert got.tolist() == [i + width <= 50 and seen[tuple(other[i : i + width].tolist())] >= 2 for i in range(50)]


def test_suffix_array_and_matching_statistics():
    rng = np.random.default_rng(7)
    for n in (1, 2, 17, 300):
        text = rng.integers(0, 3, n)
        assert suffix_array(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())
    flat = rng.integers(0, 4, 60).astype(np.uint64)
    index = FmIndex(flat, np.array([60]), np.array([1]))
    word = "".join(map(str, flat.tolist()))
    occurs = lambda x: sum(word.startswith(x, i) for i in range(60))
    ends = np.arange(1, 61)
    got = index.reach(index.numbers(flat), np.zeros(60, np.int64), ends, 2)
    assert got.tolist() == [min([a for a in range(e) if occurs(word[a:e]) >= 2], default=e) for e in ends.tolist()]


@pytest.mark.parametrize("width", [35, 9, 8, 50])
def test_runs_hold_each_window_once_and_equal_windows_share_anchors(width, monkeypatch):
    rng = random.Random(width)
    words = word_hashes((prose(rng, 300) + " x" * 200 + " " + prose(random.Random(1), 90) + " q " + prose(random.Random(1), 90)).encode())
    anchors = {}
    for stretch in (1 << 20, 64):
        monkeypatch.setattr(dup, "STRETCH", stretch)
        at = 0
        for found_, starts, sizes in dup.runs(words, width):
            for anchor, start, size in zip(found_.tolist(), starts.tolist(), sizes.tolist(), strict=True):
                assert start == at and size >= 1
                for i in range(start, start + size):
                    assert anchors.setdefault(words[i : i + width].tobytes(), anchor) == anchor
                at += size
        assert at == len(words) - width + 1


def passages(rng, n):
    """Documents of common passages of 20 to 90 words, copies, near copies, repeats inside one document."""
    shared = [prose(rng, rng.choice([20, 34, 35, 36, 50, 62, 90])) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [prose(rng, rng.randint(0, 60)) if rng.random() < 0.6 else rng.choice(shared) for _ in range(rng.randint(0, 5))]
        text = rng.choice(["  ", " ", "\n"]).join(parts)
        rows.append((i, text))
        if rng.random() < 0.3:
            words = text.split()
            for _ in range(rng.randint(0, 2)):
                if words:
                    words[rng.randrange(len(words))] = "edit"
            rows.append((n + i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("seed", "kinds", "shard", "parts"), [(1, 1024, 400_000, 3), (2, 1, 400_000, 1), (3, 2, 300, 5)])
def test_random_texts_equal_brute_force(spark, monkeypatch, seed, kinds, shard, parts):
    monkeypatch.setattr(dup, "KINDS", kinds)
    monkeypatch.setattr(dup, "SHARD", shard)
    rows = passages(random.Random(seed), 120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert found(df) == expected(rows)


@pytest.mark.parametrize("width", [1, 5, 60])
def test_other_widths(spark, width):
    rows = passages(random.Random(width), 40)
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), width) == expected(rows, width)


@pytest.mark.parametrize("kinds", [1024, 0])
def test_hard_rows(spark, hard, monkeypatch, kinds):
    """Repeated rows and ids, two texts of one id, rows without one, nulls, a word over and over, a long text."""
    monkeypatch.setattr(dup, "KINDS", kinds)
    more = [(50, "same " * 400, *[None] * 8), (51, "same " * 36, *[None] * 8), (5, prose(random.Random(8), 70), *[None] * 8), (5, prose(random.Random(8), 70) + " end", *[None] * 8)]
    df = hard.unionByName(spark.createDataFrame(more, hard.schema)).withColumns({c: hard["a"] for c in ("doc", "digest", "begins", "held", "__bits_", "level")})
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert found(df) == expected(rows)


def test_long_texts_are_cut_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(dup, "STRETCH", 100)
    rng = random.Random(4)
    long = prose(rng, 3000)
    rows = [(1, long + " " + prose(rng, 50)), (2, prose(rng, 77) + " " + long), (3, " ".join(long.split()[500:560]))]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


def test_kept_text_over_segments(monkeypatch):
    from meridian.llm import shared

    monkeypatch.setattr(shared.segments, "__defaults__", (40,))
    words = [f"w{i}" for i in range(100)]
    begins, ends = [3, 20, 60], [9, 55, 100]
    n, kept = dup._kept_text(("\n".join(words)).encode(), begins, ends)
    gone = {i for b, e in zip(begins, ends, strict=True) for i in range(b, e)}
    assert n == 100 and kept.decode().split(" ") == [w for i, w in enumerate(words) if i not in gone]


def test_nothing_of_nothing(spark, empty):
    assert found(empty) == []


def test_sql_says_the_same(spark):
    rows = [*passages(random.Random(6), 60), (None, "x " * 50), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    want = con.sql(f"SELECT doc_id, n_words, n_removed, kept_sha256 FROM ({dup.oracle_sql()})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in dup.digest(dup.dedup(df)).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted(map(repr, want)) == sorted(repr((i, n, m, sha(k))) for _, i, n, m, k in expected(rows))
