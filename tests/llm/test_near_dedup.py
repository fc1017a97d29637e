import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meridian.llm import near_dedup as nd
from meridian.llm import shared
from meridian.llm.shared import components

from .conftest import prose, thue_morse


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text, k):
    w = words(text or "")
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def corpus(seed, n=40):
    rng = random.Random(seed)
    bases = [prose(rng, rng.randint(5, 150)) for _ in range(6)]
    passage = prose(rng, 60)
    rows = []
    for i in range(n):
        w = rng.choice(bases).split()
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = prose(rng, 1)
        text = " ".join(w)
        if rng.random() < 0.3:
            text += "\n" + passage
        rows.append((i, text.upper() if rng.random() < 0.1 else text))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "a b"), (n + 3, "A  b")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == brute(rows, 4)


def test_small_buckets_and_blocks_change_nothing(spark, monkeypatch):
    rows = corpus(3, 60)
    monkeypatch.setattr(nd, "BUCKET", 3)
    monkeypatch.setattr(nd, "BLOCK", 100)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == brute(rows, 4)


def test_hard_rows(hard, empty):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(hard).collect()]
    assert len(got) == hard.count()
    by = {i: (n, c, k) for i, n, c, k in got if i is not None}
    assert by[0] == (0, 0, True) and by[1] == (0, 1, True) and by[2] == (0, 2, True) and by[3] == (1, 3, True)
    assert by[6][1:] == (5, False) and by[7][1:] == (5, False) and by[5][1:] == (5, True)
    kept = nd.keep_first(hard)
    assert kept.columns == hard.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 4, 5, 5, 8, 9, 10, 11, 12]
    assert nd.near_duplicates(empty).count() == 0 and nd.keep_first(empty).count() == 0


def rows_brute(rows, k):
    """Like ``brute``, but every row is a node: a doc_id may have several texts."""
    sets = [set(shingles(t or "", k)) for _, t in rows]
    seen = list(range(len(rows)))

    def top(i):
        while seen[i] != i:
            i = seen[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                seen[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted((doc, len(s), least[top(i)] if s else doc, doc == (least[top(i)] if s else doc)) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True)))


def with_repeated_ids(seed):
    rng = random.Random(seed)
    a, b = prose(rng, 30), prose(rng, 30)
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (3, None), (2, a + " more")]
    rows += [(rng.randint(4, 20), t) for _, t in corpus(seed, 60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 3), (3, 5)])
def test_a_doc_id_with_several_texts_loses_no_link(spark, seed, parts):
    rows = with_repeated_ids(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert sorted(tuple(r) for r in nd.near_duplicates(docs, 4).select("doc_id", "n_shingles", "component_id", "kept").collect()) == rows_brute(rows, 4)


def test_the_stage_judges_each_row_by_its_own_text(spark):
    rows = with_repeated_ids(4)
    clashing = ["__0", "__1", "__2", "__3", "__bits", "__at", "__word", "key", "class", "digest", "__n"]
    docs = spark.createDataFrame([(*r, *range(len(clashing))) for r in rows], "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in clashing))
    kept = nd.keep_first(docs, 4)
    assert kept.columns == docs.columns
    key = lambda r: (r[0], r[1] or "")
    want = [r for r in rows if _row_kept(rows, *r)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(want, key=key)


def _row_kept(rows, doc, text):
    """Whether a row's own component has no smaller doc_id, by a walk from it."""
    own = set(shingles(text or "", 4))
    near = lambda s, t: bool(s and t) and 100 * len(s & t) >= 80 * len(s | t)
    sets = [(d, set(shingles(t or "", 4))) for d, t in rows]
    todo, seen = [own], []
    while todo:
        s = todo.pop()
        if s in seen:
            continue
        seen.append(s)
        todo += [t for _, t in sets if near(s, t)]
    return not own or min(d for d, t in sets if t in seen) == doc


def test_words_that_polynomials_confuse_are_not_linked(spark):
    a, b = thue_morse()
    tail = " c d e f g"
    docs = spark.createDataFrame([(1, " ".join([a] * 9)), (2, " ".join([b] * 9)), (3, a + tail), (4, b + tail)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(docs, 4).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_rows_without_an_id_are_kept(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (5, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = [(r.doc_id, r.component_id, r.kept) for r in nd.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == [(4, 4, True), (5, 4, False), (None, None, True), (None, None, True)]


def test_filters_lose_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"t{i}", i) for i in range(3000)] + [(None, "n", 0)], "doc_id long, text string, `a.b` long")
    ids = spark.range(0, 3000, 7).withColumnRenamed("id", "doc_id")
    want = set(range(0, 3000, 7))
    for most in (shared.MOST_WORDS, 1024, 1):  # a full filter, and keys too many for any
        monkeypatch.setattr(shared, "MOST_WORDS", most)
        of = {r.doc_id for r in shared.texts_of(docs, ids).collect()}
        assert want <= of and None not in of
        assert sorted(r.doc_id for r in shared.texts_in(docs, ids).collect()) == sorted(want)
        left = shared.without(docs, ids)
        assert left.columns == docs.columns
        assert {r.doc_id for r in left.collect()} == (set(range(3000)) | {None}) - want
    plan = shared.without(docs, ids)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def test_few_ids_pick_texts_without_tables(spark, monkeypatch):
    def none(*_):
        raise AssertionError("a table is written")

    monkeypatch.setattr(shared, "table", none)
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c"), (None, "n")], "doc_id long, text string")
    ids = spark.createDataFrame([(1,), (2,), (9,), (None,)], "doc_id long")
    assert sorted(tuple(r) for r in shared.texts_in(docs, ids).collect()) == [(1, "a"), (1, "a"), (2, "")]


def test_more_ids_pick_the_same_texts_by_filters(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(3000)] + [(7, "again"), (None, "n")], "doc_id long, text string")
    ids = spark.range(0, 3000, 7).withColumnRenamed("id", "doc_id").union(spark.createDataFrame([(None,)], "doc_id long"))
    want = sorted([*range(0, 3000, 7), 7])
    for ids_, words in ((429, 1024), (428, shared.MOST_WORDS), (428, 1024), (428, 1)):  # 429 ids are just few enough
        monkeypatch.setattr(shared, "MOST_IDS", ids_)
        monkeypatch.setattr(shared, "MOST_WORDS", words)
        assert sorted(r.doc_id for r in shared.texts_in(docs, ids).collect()) == want


def test_tables_can_be_deleted(spark):
    made = shared.table(spark.range(5), "gone")
    shared.discard(made)
    with pytest.raises(Exception):  # noqa: B017
        made.count()
    shared.table(spark.range(5), "left")
    shared.clear(spark)


def test_estimate_is_corrected_for_chance(spark):
    rng = random.Random(9)
    w = [prose(rng, 1) + str(i) for i in range(4000)]
    a, b = nd.shingle_set(" ".join(w).encode(), 1), nd.shingle_set(" ".join(w[400:] + [f"n{i}" for i in range(400)]).encode(), 1)
    true = 3600 / 4400
    x, y = (nd.packed(nd.minima(s)).tolist() for s in (a, b))
    got = spark.createDataFrame([(x, y)], "x array<long>, y array<long>").select(nd.estimate("x", "y")).first()[0]
    assert abs(got - true) < 0.15


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "c\x0bd", "é", "\x1c", " "]), max_size=12))
def test_set_sizes(parts):
    text = " ".join(parts)
    assert len(nd.shingle_set(text.encode(), 4)) == len(shingles(text, 4))


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
