"""Quality classifier, quality rules and language identification."""

import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meridian.llm import language_id as li
from meridian.llm import quality_classifier as qc
from meridian.llm import quality_rules as qr

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def marks(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def test_classifier_on_held_out_rows(docs, marks):
    rows = qc.classify(docs, marks).join(marks, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.93


def test_held_out_labels_and_ids_are_not_used(docs, marks):
    flipped = marks.withColumn("quality", F.when(qc.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in qc.classify(docs, marks, 300).collect()}
    b = {r.doc_id: r.score for r in qc.classify(docs, flipped, 300).collect()}
    assert a == b


def test_gap_equals_the_softmax():
    texts, classes = [b"good clean words here", b"b@d $$$ junk!!", b"more good words", b"$$$ !!! junk"], [1, 0, 1, 0]
    model = qc.fit(texts * 30, classes * 30)
    assert [model.score(t) > 0.5 for t in texts] == [True, False, True, False]
    assert model.score(b"") == pytest.approx(1 / (1 + np.exp(-model.bias)))


def brute_score(model, text):
    """The softmax of the two classes over the mean of all vectors, feature by feature."""
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    buckets = [xxhash.xxh3_64_intdigest(w) % qc.BUCKETS for w in words]
    for n in qc.GRAMS:
        for i in range(len(text)):
            gram = text[i : i + n]
            if len(gram) == n:
                h = 0
                for c in gram:
                    h = h * 0x01000193 % 2**32 ^ ord(c) * 0x9E3779B1 % 2**32
                buckets.append((h + n) * 0x85EBCA6B % 2**32 >> 14)
    mean = model.vectors[buckets].astype(np.float64).mean(0) if buckets else np.zeros(qc.DIMENSIONS)
    z = model.out.astype(np.float64) @ mean + model.bias_of.astype(np.float64)
    p = np.exp(z - z.max())
    return p[1] / p.sum()


def test_scores_equal_brute_force():
    good, bad = ["good clean words here", "more göod words, and good ones"], ["b@d $$$ junk!!", "$$$ !!! junk $$$"]
    model, learned = qc.trained([t.encode() for t in (good + bad) * 20], [1, 1, 0, 0] * 20)
    for text in [*good, *bad, "", "x", "other wörds 日本"]:
        assert model.score(text.encode()) == pytest.approx(brute_score(learned, text), rel=1e-4)


def test_samples_do_not_depend_on_partitions(spark):
    docs = [(i % 40, f"text {i} of {i % 40}", ["en", "de", None][i % 3]) for i in range(200)]
    labels = spark.createDataFrame([(i % 40, i % 2) for i in range(90)], "doc_id long, quality int")
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = [(qc.sample(df.repartition(n), labels.repartition(n), 25), li.sample(df.repartition(n), 25)) for n in (1, 5)]
    assert got[0] == got[1] and len(got[0][0]) == 25 and len({t for t, _ in got[0][1]}) == len(got[0][1])
    assert all((t, lang) in {(x, y) for _, x, y in docs} for t, lang in got[0][1])  # a text with its own language


def test_features_do_not_depend_on_stretches(monkeypatch):
    text = ("añb cde " * 50).encode()
    whole = np.sort(np.concatenate(list(qc.feature_ids(text))))
    monkeypatch.setattr(qc, "_SLAB", 7)
    assert (np.sort(np.concatenate(list(qc.feature_ids(text)))) == whole).all()


def test_classifier_hard_rows(hard, empty, labels, no_labels):
    rows = qc.classify(hard, labels).collect()
    assert len(rows) == hard.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert {r.score for r in qc.classify(hard, no_labels).collect()} == {0.5}
    assert qc.classify(empty, labels).count() == 0
    assert qc.keep_good(hard, labels).columns == hard.columns


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dups = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    inside = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(inside)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é#", "$x", "\n", " ", "\x0b", "\x1c", " ", "|", "\n \n"]), max_size=80))
def test_base_counts(parts):
    text = " ".join(parts)
    assert qr.base_counts(text.encode()) == brute_counts(text)


def test_base_counts_with_many_words():
    text = " ".join(f"w{i % 20_000}" for i in range(20_003))
    assert qr.base_counts(text.encode()) == brute_counts(text)


def test_rules_equal_brute_force(docs, marks):
    rows = docs.select("doc_id", "text").limit(200).collect()
    got = {r.doc_id: r for r in qr.apply_rules(docs, marks).collect()}
    for r in rows:
        n, chars, symbols, dups, repeats = brute_counts(r.text)
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (n, chars, symbols, dups, repeats)
        assert g.base_failed == (n < 10 or 100 * repeats > 20 * n) and g.kept == (not g.base_failed and g.llr >= qr.THRESHOLD)


def test_ratio_equals_brute_force(spark, docs, marks):
    few, own = docs.limit(60).cache(), marks
    good = {r.doc_id for r in own.where("quality = 1").collect()}
    raw, target = np.zeros(qr.BUCKETS), np.zeros(qr.BUCKETS)
    for r in few.collect():
        for i in range(len(r.text.encode()) - 3):
            b = int.from_bytes(r.text.encode()[i : i + 4], "little") * 0x9E3779B1 % 2**32 >> 16
            raw[b] += 1
            target[b] += r.doc_id in good
    assert (qr.gram_counts(few) == raw).all() and (qr.gram_counts(qr.trusted_texts(few, own)) == target).all()


def test_verdicts_equal_brute_force(spark, docs, marks):
    """Ratios and verdicts from plain dictionaries of byte n-grams in their buckets."""
    rows = [(r.doc_id, r.text or "") for r in docs.limit(120).collect()] + [(9_000_001, ""), (9_000_002, "ab c")]
    good = {r.doc_id for r in marks.where("quality = 1").collect()}

    def grams(text):
        b = text.encode()
        return [int.from_bytes(b[i : i + 4], "little") * 0x9E3779B1 % 2**32 >> 16 for i in range(len(b) - 3)]

    raw, target = Counter(), Counter()
    for i, text in rows:
        raw.update(grams(text))
        if i in good:
            target.update(grams(text))
    n, m = sum(raw.values()), sum(target.values())

    def ratio(g):
        return math.log((target[g] + qr.PRIOR) / (raw[g] / n * m + qr.PRIOR))

    got = {r.doc_id: r for r in qr.apply_rules(spark.createDataFrame(rows, "doc_id long, text string"), marks).collect()}
    for i, text in rows:
        own = grams(text)
        llr = sum(map(ratio, own)) / len(own) if own else 0.0
        words, _, _, _, repeats = brute_counts(text)
        failed = words < 10 or 100 * repeats > 20 * words
        assert got[i].llr == pytest.approx(llr, abs=1e-9) and got[i].base_failed == failed
        assert got[i].kept == (not failed and llr >= qr.THRESHOLD)
    assert {r.kept for r in got.values()} == {True, False}


@pytest.mark.parametrize("rows", [200, 1000])
def test_verdicts_are_alike_at_every_size(docs, marks, rows):
    few = docs.orderBy("doc_id").limit(rows)
    judged = qr.apply_rules(few, marks).join(marks, "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept for r in judged if r.quality == 1]) > 0.98 and np.mean([r.kept for r in judged if r.quality == 0]) < 0.2


def test_rules_keep_good_and_drop_bad(docs, marks):
    rows = qr.apply_rules(docs, marks).join(marks, "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.98 and np.mean([r.kept for r in rows if r.quality == 0]) < 0.1


def test_rules_hard_rows(hard, empty, labels, no_labels):
    rows = {r.doc_id: r for r in qr.apply_rules(hard, labels).collect()}
    assert len(rows) == 14 and rows[0].base_failed and not rows[0].kept and rows[0].llr == 0 and rows[8].n_words == 1
    assert all(r.llr == 0 and r.kept == (not r.base_failed) for r in qr.apply_rules(hard, no_labels).collect())
    assert qr.apply_rules(empty, labels).count() == 0 and qr.keep_good(hard, labels).columns == hard.columns


def test_language_on_held_out_rows(docs):
    rows = li.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 100 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.97


def test_rare_language_is_learned_and_not_barred(spark):
    en, nn = "the cat and the dog with that house", "eg veit ikkje kva hesten heiter på garden"
    model = li.fit([(en, "en")] * 1992 + [(nn, "nn")] * 8)
    assert [x[0] for x in li.label_texts(model, [nn, en])] == ["nn", "en"]
    rows = [(i, f"{en} {i}", "en") for i in range(3000)] + [(i, nn, "nn") for i in range(5000, 5010)]
    chosen = li.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), rows=100)
    usable = [i for i in range(5000, 5010) if zlib.crc32(str(i).encode()) % 5]
    assert len(chosen) == 100 and [t for t, lang in chosen if lang == "nn"] == [nn] * len(usable) and usable
    assert li.quotas({"a": 10, "b": 2, "c": 9}, 12) == {"a": 5, "b": 2, "c": 5}


def brute_viterbi(scores, penalty):
    best, back = scores[0].astype(float), []
    for s in scores[1:]:
        top = best.argmax()
        hop = best[top] - penalty > best
        back.append(np.where(hop, top, np.arange(len(best))))
        best = np.where(hop, best[top] - penalty, best) + s
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_viterbi_equals_one_text_at_a_time():
    rng = np.random.default_rng(4)
    lengths = np.array([3, 0, 17, 1, 17, 40])
    scores = rng.normal(0, 5, (lengths.sum(), 3)).astype(np.float32)
    got, at = li.viterbi(scores, lengths), 0
    for n in lengths:
        if n:
            assert got[at : at + n].tolist() == brute_viterbi(scores[at : at + n], li.SWITCH_PENALTY)
        at += n


def brute_language(pairs, texts):
    """The whole way from sample to prediction, word by word with plain dictionaries."""
    langs = sorted({lang for _, lang in pairs})

    def script(c):
        return next((i for i, r in enumerate(li.SCRIPTS.values()) if any(a <= ord(c) <= b for a, b in r)), -1)

    def features(text):
        out, low = [], text.lower()
        for m in re.finditer(r"[^\W\d_]+", low):
            word = [ord(c) for c in m.group()]
            padded = [0, *word, 0]
            twos, threes = [], []
            for i in range(len(word)):
                two = padded[i] * 0x9E3779B1 % 2**32 ^ padded[i + 1] * 0x85EBCA6B % 2**32
                three = two * 0xC2B2AE35 % 2**32 ^ padded[i + 2] * 0x27D4EB2F % 2**32
                twos.append(two * 0x2C1B3C6D % 2**32 >> 16)
                threes.append(three * 0x2C1B3C6D % 2**32 >> 16)
            out.append((twos, threes, script(m.group()[0]), len(word)))
        return out

    counts = {lang: (Counter(), Counter()) for lang in langs}
    used = {lang: Counter() for lang in langs}
    for text, lang in pairs:
        for twos, threes, s, n in features(text):
            counts[lang][0].update(twos)
            counts[lang][1].update(threes)
            used[lang][s] += n
    log = lambda c, g: math.log((c[g] + li.SMOOTHING) / (sum(c.values()) + li.SMOOTHING * li.BUCKETS))
    out = []
    for text in texts:
        found = features(text)
        if not found:
            out.append("und")
            continue
        scores = []
        for twos, threes, s, _ in found:
            allowed = [used[x][s] / max(1, sum(used[x].values())) >= li.SCRIPT_SHARE for x in langs]
            allowed = allowed if any(allowed) else [True] * len(langs)
            scores.append([sum(log(counts[x][0], g) for g in twos) + sum(log(counts[x][1], g) for g in threes) + (0 if ok else li.EXCLUDED) for x, ok in zip(langs, allowed, strict=True)])
        letters = Counter()
        for k, (_, _, _, n) in zip(brute_viterbi(np.array(scores), li.SWITCH_PENALTY), found, strict=True):
            letters[langs[k]] += n
        out.append(max(langs, key=lambda x: letters[x]))
    return out


def test_predictions_equal_brute_force(spark):
    en, de, ru = "the cat and the dog with that house", "der hund und die katze mit dem haus nicht", "это просто слова и ещё слова"
    rows = [(i, f"{t} {chr(97 + i % 26)}", lang) for i, (t, lang) in enumerate([(en, "en"), (de, "de"), (ru, "ru")] * 12)]
    rows += [(100, "the dog, der hund und das haus mit der katze nicht", None), (101, "слова the cat", None), (102, "12 — 34", None), (103, None, None), (104, "그리고", None), (105, "ß", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pairs = [(t, lang) for i, t, lang in rows if lang and zlib.crc32(str(i).encode()) % 5]
    got = {r.doc_id: r.lang_pred for r in li.identify(docs).collect()}
    want = brute_language(pairs, [t or "" for _, t, _ in rows])
    assert [got[i] for i, _, _ in rows] == want and set(want) == {"en", "de", "ru", "und"}


def test_long_texts_in_stretches_equal_whole_ones(monkeypatch):
    model = li.fit([("the cat and the dog with that house " * 9, "en"), ("der hund und die katze mit dem haus nicht " * 9, "de")])
    rng = np.random.default_rng(1)
    words = ["the", "dog", "house", "hund", "katze", "nicht", "und", "x", "42", "—", "unbekanntelangeswort" * 3]
    text = " ".join(rng.choice(words, 400))
    whole = next(li.label_texts(model, [text]))
    for slab in (1, 7, 50, 1000):
        monkeypatch.setattr(li, "SLAB", slab)
        assert next(li.label_texts(model, [text])) == whole
        assert list(li.label_texts(model, ["the dog", text, "", "und"]))[1:3] == [whole, ("und", 0.0, [])]


def test_mixed_text_gives_spans():
    model = li.fit([("the cat and the dog with that house " * 9, "en"), ("der hund und die katze mit dem haus nicht " * 9, "de"), ("это просто слова и ещё слова " * 9, "ru")])
    text = "the dog and that house with the cat. der hund und das haus mit der katze nicht слова и слова"
    lang, score, spans = next(li.label_texts(model, [text]))
    assert [s[2] for s in spans] == ["en", "de", "ru"] and 0 < score < 1
    assert text[spans[2][0] : spans[2][1]] == "слова и слова"
    assert [x[0] for x in li.label_texts(model, ["12 34", "", "слова", "THE DOG"])] == ["und", "und", "ru", "en"]


def test_scripts_have_letters_only():
    table = li.script_of()
    assert table[ord("1")] == 0 and table[ord("_")] == 0 and table[ord("é")] == table[ord("a")] > 1 and table[ord("ж")] != table[ord("a")]
    assert all((table[c] > 0) == unicodedata.category(chr(c)).startswith("L") for c in range(0x3000))


def test_language_hard_rows(hard, empty):
    rows = {r.doc_id: r for r in li.identify(hard).collect()}
    assert {r.lang_pred for i, r in rows.items() if i in (0, 1, 2)} == {"und"}
    assert {r.lang_pred for r in rows.values()} <= {"und", "en"} and all(0 <= r.score <= 1 for r in rows.values())
    assert li.identify(empty).count() == 0
