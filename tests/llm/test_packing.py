import itertools
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meridian.llm import packing as pk
from meridian.llm.shared import WordTable

from .conftest import thue_morse

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a b", "Don't STOP!", "<|endoftext|> A", "<|ENDOFTEXT|>", "É é ÀB.", "éa", " x y", "a\x1cb", "² ½ x²", "ΑΣ σς", "日本語 テスト", "a..b,c. d,", "x" * 300, "ŉ ǆ ß.", "\x00"]


def library(texts):
    return [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_library():
    assert list(pk.encode([t.encode() for t in ODD], PATH)) == library(ODD)
    assert [b for t in ODD for b in pk.encode([t.encode()], PATH)] == library(ODD)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abzAZ.,'!é É\n\t<|>09²ß́日")), min_size=1, max_size=5))
def test_ids_of_random_texts(texts):
    assert list(pk.encode([t.encode() for t in texts], PATH)) == library(texts)


def test_a_full_cache_and_long_texts(monkeypatch):
    monkeypatch.setattr(pk, "WordTable", lambda: WordTable(64, 200, 300))
    monkeypatch.setattr(pk, "_GROUP", 40)
    pk._loaded.clear()
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "Gamma.", f"w{rng.randrange(90)}"]) for _ in range(60)) for _ in range(5)]
    assert list(pk.encode([t.encode() for t in texts], PATH)) == library(texts)
    pk._loaded.clear()


def test_words_that_polynomials_confuse():
    texts = list(thue_morse())
    assert list(pk.encode([t.encode() for t in texts], PATH)) == library(texts) and len(set(library(texts))) == 2


def optimum(lengths, capacity):
    for bins in range(1, len(lengths) + 1):
        for assign in itertools.product(range(bins), repeat=len(lengths)):
            if all(sum(n for n, b in zip(lengths, assign, strict=True) if b == k) <= capacity for k in range(bins)):
                return bins
    return 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=6))
def test_bound_and_packing_bracket_the_optimum(lengths):
    n = np.array(lengths)
    bins = pk.best_fit_decreasing(n, 20)
    assert np.bincount(bins, n).max() <= 20
    assert pk.lower_bound(n, 20) <= optimum(lengths, 20) <= bins.max() + 1


def test_bound_beats_the_sum():
    assert pk.lower_bound(np.array([11] * 5), 20) == 5 and pk.lower_bound(np.array([7] * 6), 20) == 3


def part(lengths, sequences=None):
    n = len(lengths)
    return pd.DataFrame({"doc_id": range(n), "piece": 0, "length": lengths, "sequence_id": sequences or [0] * n, "partition": 0})


def test_certified_partitions_are_left_alone_and_gaps_release(monkeypatch):
    even = pk.packed_partition(part([12, 8, 15, 5, 20]), 3, 0, 0, 20)
    assert not even["open"].any() and even["sequence_id"].nunique() == 3
    # 7, 7 and 7, 7 leave 6 each, and 9, 9 leave 2: five bins of 20 for a bound of 4
    gap = part([9, 9, 7, 7, 7, 7, 7, 7, 5])
    own = pk.packed_partition(gap, 0, 0, 0, 20)
    bins, bound = own["sequence_id"].nunique(), pk.lower_bound(gap["length"].to_numpy(), 20)
    assert own[own["open"]]["sequence_id"].nunique() == (bins - bound + 1 if bins > bound else 0)
    for low in (0, 1, bins - 1, bins):  # the bound decides how many go
        monkeypatch.setattr(pk, "lower_bound", lambda lengths, capacity, low=low: low)
        out = pk.packed_partition(gap, 0, 0, 0, 20)
        assert out[out["open"]]["sequence_id"].nunique() == (min(bins, bins - low + 1) if bins > low else 0)
        opened = out.groupby("sequence_id").agg(fill=("length", "sum"), open=("open", "first"))
        assert not opened["open"].any() or opened["open"].all() or opened[opened["open"]]["fill"].max() <= opened[~opened["open"]]["fill"].min()


def test_an_exchange_counts_only_where_it_saves():
    same = pk.packed_partition(part([11, 12], [5, 9]), 0, 1, 0, 20)
    assert same["sequence_id"].tolist() == [5, 9] and (same["partition"] == 0).all()
    fewer = pk.packed_partition(part([11, 9, 5], [5, 9, 7]), 2, 1, 0, 20)
    assert fewer["sequence_id"].nunique() == 2 and (fewer["partition"] == (1 << 40) + 2).all()


def test_exchange_brings_bins_to_the_bound(spark, monkeypatch):
    monkeypatch.setattr(pk, "PER_PARTITION", 30)
    rng = random.Random(3)
    rows = [(i, 0, 0, rng.choice([7, 8, 11, 13, 24, 31, 40]), 0) for i in range(900)] + [(None, 0, 0, 5, 0)]
    cut = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = pk.pack(cut, 64).collect()
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 64 and len(got) == 901 and sum(r.doc_id is None for r in got) == 1
    floor = pk.global_bound(cut, 64)
    alone = sum(pk.best_fit_decreasing(np.array([r[3] for r in rows[i : i + 30]]), 64).max() + 1 for i in range(0, 901, 30))
    whole = pk.best_fit_decreasing(np.array([r[3] for r in rows]), 64).max() + 1
    assert floor <= len(fill) <= whole + 1 < alone
    by = {}
    for r in got:
        by.setdefault(r.partition, []).append(r)
    for own in by.values():
        bins, bound = len({r.sequence_id for r in own}), pk.lower_bound(np.array([r.length for r in own]), 64)
        assert {(r.bins, r.bound, r.certified) for r in own} == {(bins, bound, bins == bound)}


def _check(rows, ids, capacity):
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append(r)
    for own in used.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for doc, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) * 4 == len(ids[doc])
        for r in own:
            assert r.start == r.piece * capacity and (r.length == capacity or r.piece == len(own) - 1)
            assert r.ids_crc32 == zlib.crc32(ids[doc][4 * r.start : 4 * (r.start + r.length)])
    return len(used)


def test_pieces_and_sequences(spark, monkeypatch):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randint(0, 90))) for i in range(300)} | {i + 1000: t for i, t in enumerate(ODD)}
    ids = {i: b + b"\x01\0\0\0" for i, b in zip(texts, library(list(texts.values())), strict=True)}
    monkeypatch.setattr(pk, "PER_PARTITION", 40)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = pk.pack_documents(docs, PATH, capacity=64).collect()
    total = sum(r.length for r in rows)
    assert _check(rows, ids, 64) <= -(-total // 64) + 2


def test_hard_rows(hard, empty):
    rows = pk.pack_documents(hard, PATH).collect()
    every = library([r.text or "" for r in hard.collect()])
    assert sum(r.length for r in rows) == sum(len(b) // 4 + 1 for b in every)
    twice = [r.ids_crc32 for r in rows if r.doc_id == 5]
    assert len(twice) == 2 and len(set(twice)) == 1 and sum(r.doc_id is None for r in rows) == 1
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in used.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 4096
    rows = pk.pack_documents(hard.where("doc_id is not null").dropDuplicates(["doc_id"]), PATH).collect()
    texts = {r.doc_id: r.text or "" for r in hard.where("doc_id is not null").collect()}
    ids = {i: b + b"\x01\0\0\0" for i, b in zip(texts, library(list(texts.values())), strict=True)}
    _check(rows, ids, 4096)
    assert pk.pack_documents(hard, PATH).agg(F.countDistinct("sequence_id", "offset")).first()[0] == pk.pack_documents(hard, PATH).count()
    assert pk.pack_documents(empty, PATH).count() == 0
