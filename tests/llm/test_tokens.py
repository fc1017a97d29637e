"""Token attribution and the max-plus scan."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meridian.llm import sentencepiece_scan as sp
from meridian.llm import token_counts as tc
from meridian.llm.shared import WordTable, words_in

from .conftest import prose, thue_morse

VOCABULARY, PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


def _rows(df):
    return sorted((r.doc_id, r.field, r.section, r.start, r.end, r.n_tokens) for r in df.collect())


def test_counts_equal_the_library_offsets(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one line", "two\nlines here", "a\n\n\nb  \n", "日本語\nтекст é\n", "", "\n", "x" * 50 + "\n" + "y" * 50]
    got = _rows(tc.attribute(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), VOCABULARY, public_tokenizers.PATTERN))
    want = []
    for i, text in enumerate(texts):
        starts = [a for a, _ in tokenizer.encode(text, add_special_tokens=False).offsets]
        at = 0
        lines = text.split("\n")
        for j, line in enumerate(lines):
            end = at + len(line) + (j < len(lines) - 1)
            want.append((i, "text", j, at, end, float(sum(at <= s < end for s in starts))))
            at = end
    assert got == sorted(want)


def brute_allocate(tokens, sections, rule):
    counts, bounds = [0.0] * len(sections), list(zip([0, *sections], sections))  # noqa: B905
    for a, b in zip([0, *tokens], tokens):  # noqa: B905
        shares = [max(0, min(b, e) - max(a, s)) for s, e in bounds]
        touched = [i for i, x in enumerate(shares) if x]
        if rule == "share":
            for i in touched:
                counts[i] += shares[i] / (b - a)
        else:
            counts[{"first": touched[0], "last": touched[-1], "most": max(touched, key=lambda i: (shares[i], -i))}[rule]] += 1
    return counts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=8), st.data())
def test_rules(sizes, data):
    tokens = np.cumsum(sizes)
    total = int(tokens[-1])
    sections = np.array(sorted(data.draw(st.lists(st.integers(0, total), max_size=4))) + [total])
    for rule in tc.RULES:
        got, _ = tc.allocate(tokens, sections, rule)
        assert got.tolist() == pytest.approx(brute_allocate(tokens.tolist(), sections.tolist(), rule)) and got.sum() == pytest.approx(len(sizes))


def test_fields(spark):
    docs = spark.createDataFrame([(1, "Title words", "Body text\nmore"), (2, None, "x")], "doc_id long, title string, body string")
    rows = _rows(tc.attribute(docs, VOCABULARY, public_tokenizers.PATTERN, ("title", "body"), lines=False))
    assert [r[:5] for r in rows] == [(1, "body", 0, 12, 26), (1, "title", 0, 0, 12), (2, "body", 0, 1, 2), (2, "title", 0, 0, 1)]
    lines = _rows(tc.attribute(docs, VOCABULARY, public_tokenizers.PATTERN, ("title", "body"), "share"))
    assert sum(r[5] for r in lines) == pytest.approx(sum(r[5] for r in rows))
    with pytest.raises(ValueError):
        tc.attribute(docs, VOCABULARY, public_tokenizers.PATTERN, rule="odd")


def test_counts_hard_rows(hard, empty):
    got = _rows(tc.attribute(hard.where("doc_id is not null"), VOCABULARY, public_tokenizers.PATTERN))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = []
    for r in hard.where("doc_id is not null").collect():
        text, at = r.text or "", 0
        starts = np.array([a for a, _ in tokenizer.encode(text, add_special_tokens=False).offsets])
        lines = text.split("\n")
        for j, line in enumerate(lines):
            end = at + len(line) + (j < len(lines) - 1)
            want.append((r.doc_id, "text", j, at, end, float(((starts >= at) & (starts < end)).sum())))
            at = end
    assert got == sorted(want)
    assert tc.attribute(hard, VOCABULARY, public_tokenizers.PATTERN).where("doc_id is null").count() == 1
    assert tc.attribute(empty, VOCABULARY, public_tokenizers.PATTERN).count() == 0


@pytest.fixture(scope="module")
def model():
    return sp.model(PIECES)


def ids_of(model, text):
    return np.frombuffer(model.encode(text)[0], "<u4").tolist()


def test_best_scores_equal_the_library(model):
    """The library's own lattice over the same pieces and scores, read as a unigram model."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(PIECES, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    score = lambda ids: sum(library.get_score(i) for i in ids)
    for word in ["the", "thinking", "ofoneredon", "Hello", "étions", "quevi", "zzzz", "internationalisation"]:
        own = ids_of(model, word)
        assert score(own) == score(library.nbest_encode_as_ids(word, 3)[0])


def scanned(model, text, chunk):
    s = sp.prepared(text)
    parts = []
    for at in range(0, len(s), chunk):
        size, word = min(chunk, len(s) - at), at
        while word and not sp.cut(s, word):
            word -= 1
        parts.append((s[at : at + size + model.longest + 1], size, at - word))
    matrices = [model.matrix(*p) for p in parts]
    return [i for p, (a, b) in zip(parts, sp.states(matrices, 0, 0), strict=True) for i in model.chunk_ids(*p, a, b)] if parts else []


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("abehinorst  é日\n▁▁"), max_size=120), st.sampled_from([5, 16, 23, 50]))
def test_scan_equals_the_plain_pass(text, chunk):
    model = sp.model(PIECES)
    assert scanned(model, text, chunk) == ids_of(model, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("abehi  é\n▁"), max_size=20), max_size=5))
def test_together_equals_word_by_word(texts):
    model = sp.model(PIECES)
    words = [[model._word(w) for w in sp.words_of(sp.prepared(t))] for t in texts]
    assert model.encode_all(texts) == [(b"".join(ids for ids, _ in own), sum(w >> sp._SHIFT for _, w in own) / sp._SCALE) for own in words]


_LETTERS = st.sampled_from("abehinorstquv0'é日😀\x00\x7f")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["", " "]), st.text(_LETTERS, min_size=1, max_size=90)).map("".join), max_size=60), st.sampled_from([1, 16]))
def test_words_side_by_side_equal_words_one_by_one(words, few):
    """Short and long words, characters without a piece, equal scores, and slices of a few words."""
    model, was = sp.model(PIECES), (sp._SLICE, sp._FEW)
    words.append("\n")
    sp._SLICE, sp._FEW = 100, few
    try:
        ids, counts, scores = model.words([w.encode() for w in words])
    finally:
        sp._SLICE, sp._FEW = was
    want = [model._word(w.replace(" ", "▁")) for w in words]
    assert ids.astype("<u4").tobytes() == b"".join(i for i, _ in want) and counts.tolist() == [len(i) // 4 for i, _ in want]
    assert scores.tolist() == [(w >> sp._SHIFT) / sp._SCALE for _, w in want]


def test_new_words_are_not_segmented_one_by_one(monkeypatch):
    model, rng, asked = sp.Model(PIECES), random.Random(4), []
    text = prose(rng, 3000)
    want = [model._word(w) for w in sp.words_of(sp.prepared(text))]
    plain = model._word
    monkeypatch.setattr(model, "_word", lambda s: asked.append(s) or plain(s))
    assert model.encode(text) == (b"".join(ids for ids, _ in want), sum(w >> sp._SHIFT for _, w in want) / sp._SCALE)
    assert len(asked) < sp._FEW < len(set(text.split()))


def test_words_that_polynomials_confuse(model):
    a, b = thue_morse()
    got = [ids for ids, _ in model.encode_all([a, b, f"{a} {b}"])]
    assert got[0] != got[1] and [model.decode(np.frombuffer(x, "<u4").tolist()) for x in got] == [a, b, f"{a} {b}"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.text(st.sampled_from("ab\0é"), min_size=1, max_size=20), st.sampled_from(["a", "a\0", "x" * 15, "x" * 16, "x" * 40])), max_size=30), max_size=6), st.sampled_from([(4, 20, 60), (64, 30, 400), (1 << 12, 10_000, 1 << 20)]))
def test_a_small_table_says_what_a_large_one_does(calls, sizes):
    table = WordTable(*sizes)
    for words in calls:
        asked = []

        def make(new):
            asked.extend(new)
            return [(list(w), float(len(w))) for w in new]

        data = " ".join(words).encode()
        starts, ends = words_in(data)
        ids, counts, values = table.look_up(data, starts, ends, make)
        whole = [w.encode() for w in words]
        assert ids.tolist() == [x for w in whole for x in w] and counts.tolist() == [len(w) for w in whole] == values.tolist()
        assert len(asked) == len(set(asked)) and set(asked) <= set(whole)


def test_the_last_cut_is_carried_along(spark, model):
    """Without any cut a chunk must not walk back to the text's start: twice the text is at most about twice the looks."""
    looks, plain = [], sp.cut
    texts = ["ab" * n for n in (4000, 8000)]

    class Counted:
        def __init__(self):
            self.n = 0

        def __call__(self, s, i):
            self.n += 1
            return plain(s, i)

    for text in texts:
        s, word, low, counted = sp.prepared(text), 0, 0, Counted()
        for at in range(0, len(s), 64):
            want = max((i for i in range(at + 1) if i and plain(s, i)), default=0)
            word = sp.last_cut(s, at, low, word, counted)
            low = at
            assert word == want
        looks.append(counted.n)
    assert looks[1] <= 2.1 * looks[0]


def test_products_are_associative(model):
    s = sp.prepared("thinkingoverthewholething" * 4)
    parts = [(s[at : at + 20 + model.longest + 1], min(20, len(s) - at), at) for at in range(0, len(s), 20)]
    a, b, c = (model.matrix(*p) for p in parts[:3])
    assert sp.combine(sp.combine(a, b), c) == sp.combine(a, sp.combine(b, c))


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_decoding_gives_the_text_back(text):
    model = sp.model(PIECES)
    assert model.decode(ids_of(model, text)) == text.replace("▁", " ")


def test_giant_texts_through_spark(spark, model, monkeypatch):
    monkeypatch.setattr(sp, "GROUP", 3)
    rng = random.Random(8)
    texts = ["".join(rng.choice("theinrao \n") for _ in range(n)) for n in (10, 900, 1500, 2000)] + ["t" * 700, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(2, texts[2])], "doc_id long, text string")
    rows = sp.encode(docs, PIECES, 64).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        ids, total = model.encode(texts[r.doc_id] or "")
        assert bytes(r.ids) == ids and r.score == pytest.approx(total) and r.n_chunks == (1 if len(texts[r.doc_id] or "") <= 128 else -(-(len(texts[r.doc_id]) + 1) // 64))
    assert {r.doc_id: r.text for r in sp.decode(sp.encode(docs, PIECES, 64), PIECES).collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_giant_texts_are_told_apart_by_numbers_not_hashes(spark, monkeypatch):
    """Giants that share their doc_id, repeated ones, and any hash function made to collide."""
    monkeypatch.setattr(sp.F, "xxhash64", lambda *_: sp.F.lit(7).cast("long"))
    rng = random.Random(12)
    texts = [prose(rng, 60) for _ in range(4)]
    docs = spark.createDataFrame([(1, t) for t in texts] + [(1, texts[0]), (2, texts[1]), (None, texts[2])], "doc_id long, text string").repartition(3)
    for limit in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        got = sp.round_trip(docs, PIECES, 64).collect()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert all(r.same and r.n_chunks > 1 for r in got)
        assert sorted(r.text_sha256 for r in got) == sorted(hashlib.sha256(r[1].encode()).hexdigest() for r in docs.collect())
        ids = {r.text_sha256: r.ids_crc32 for r in got}
        assert len(set(ids.values())) == 4


def test_scan_hard_rows(hard, empty):
    rows = sp.round_trip(hard, PIECES).collect()
    texts = [r.text or "" for r in hard.collect()]
    assert sorted(r.decoded_sha256 for r in rows) == sorted(hashlib.sha256(t.replace("▁", " ").encode()).hexdigest() for t in texts)
    assert sp.round_trip(empty, PIECES).count() == 0
