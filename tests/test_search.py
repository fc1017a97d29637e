"""Keyword, vector and hybrid search, held against the FTS of the standard library where it has one."""

import random
import sqlite3
import unicodedata

import pytest
from hypothesis import HealthCheck, assume, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meridian.functions.scores import keyword_score, semantic_score
from meridian.functions.text import fold, org_of_register, phrases_of, row_id, spaced_tokens, strip_scheme
from meridian.operators import hybrid, keyword, vector
from meridian.sources.embeddings import KeywordPresence, embed

ROWS = [
    ("a", "geo feature", "a sensor of features", ["geo", "x"], "geo feature geo"),
    ("b", "Café", "geo-feature", [], "unrelated feature text geo geo"),
    ("c", "sensor", None, ["feature"], "the geo_feature"),
    ("d", "other", "words only", None, "geo"),
    ("e", "plain", "nothing here", None, "at all"),
]


@pytest.fixture(scope="module")
def indexed(spark):
    df = spark.createDataFrame(ROWS, "id string, name string, abstract string, tags array<string>, description string")
    return keyword.index(df.withColumn("item_identifier", F.col("id"))).cache()


def _reference(query):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(name, abstract, tags, item_identifier, description)")
    for i, n, a, t, d in ROWS:
        db.execute("insert into t values (?, ?, ?, ?, ?)", (n, a, " ".join(t or []), i, d))
    match = " ".join('"' + w.replace('"', '""') + '"' for w in query.split())
    return {r[0]: -r[1] for r in db.execute("select item_identifier, bm25(t, 5, 2, 1, 1, 1) from t where t match ?", (match,))}


@pytest.mark.parametrize("query", ["geo", "feature geo", "geo-feature", "cafe", "geo_feature sensor", "features", "geo geo", "words", "missing"])
def test_bm25_equals_fts(indexed, query):
    got = {r.id: r.relevance for r in keyword.search(indexed, query).collect()}
    want = _reference(query)
    assert set(got) == set(want)
    assert all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want)


@pytest.fixture(scope="module")
def posted(spark, tmp_path_factory):
    df = spark.createDataFrame(ROWS, "id string, name string, abstract string, tags array<string>, description string")
    rows = df.withColumn("item_identifier", F.col("id"))
    path = str(tmp_path_factory.mktemp("postings"))
    keyword.write_postings(keyword.postings(rows, filters=("name",)), path, keyword.lengths(rows))
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")


@pytest.mark.parametrize("query", ["geo", "feature geo", "geo-feature", "cafe", "geo_feature sensor", "features", "geo geo", "words", "missing", "geo-feature-geo", "- ()"])
def test_postings_equal_the_index(indexed, posted, query):
    got = {r.id: r.relevance for r in keyword.search_postings(*posted, query).collect()}
    want = {r.id: r.relevance for r in keyword.search(indexed, query).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_postings_filter_leaves_scores_and_prunes(posted):
    every = {r.id: r.relevance for r in keyword.search_postings(*posted, "geo").collect()}
    df = keyword.search_postings(*posted, "geo", filters=F.col("name") == "Café")
    assert {r.id: r.relevance for r in df.collect()} == {"b": every["b"]}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(bucket" in plan.replace("isnotnull", "") or "PartitionFilters: [isnotnull(bucket" in plan
    assert "In(token, [geo])" in plan or "EqualTo(token,geo)" in plan


def _many(spark, seed, n=400):
    """Rows of very different lengths, words from common to rare, in several fields."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    text = lambda most: " ".join(rng.choice(words[: rng.choice([3, 10, 60])]) for _ in range(int(most ** rng.random())))
    rows = [(f"k{i:04}", text(8), text(200), [text(4)], text(3000), rng.choice("xy")) for i in range(n)]
    return spark.createDataFrame([*rows, ("empty", None, None, None, None, "x")], "id string, name string, abstract string, tags array<string>, description string, kind string").withColumn("item_identifier", F.col("id"))


@pytest.mark.parametrize(("seed", "slot_rows", "bucket_tokens"), [(1, 16, 8_000_000), (2, 8, 2000)])
def test_block_search_equals_the_full_scan_and_reads_less(spark, tmp_path, monkeypatch, seed, slot_rows, bucket_tokens):
    monkeypatch.setattr(keyword, "SLOT_ROWS", slot_rows)
    monkeypatch.setattr(keyword, "BUCKET_TOKENS", bucket_tokens)
    rows, path = _many(spark, seed), str(tmp_path)
    keyword.write_postings(keyword.postings(rows, filters=("kind",)), path, keyword.lengths(rows))
    held, blocks, stats = (spark.read.parquet(f"{path}/{n}") for n in ("postings", "blocks", "lengths"))
    assert (held.select("bucket").distinct().count() == 1) == (bucket_tokens > 10_000)
    indexed = keyword.index(rows).cache()
    seen = []
    for query, filters, limit in (("w1", None, 5), ("w1 w2 w1", F.col("kind") == "y", 3), ("w40", None, 50), ("w0 w30 w50", None, 2), ("w0 none", None, 5), ("- ,", None, 5), ("w1-w2 w0", None, 4), ("w2 w1", F.lit(False), 4)):
        want = [(r.id, round(r.relevance, 9)) for r in keyword.search(indexed, query, filters=filters, limit=limit).collect()]
        got = [(r.id, round(r.relevance, 9)) for r in keyword.search_blocks(held, blocks, stats, query, filters=filters, limit=limit, report=seen.append).collect()]
        assert got == want, query
    assert seen[0]["read"] < seen[0]["slots"] and seen[1]["read"] < seen[1]["slots"] and seen[0]["rounds"] >= 1
    frequencies = {r.token: r.n for r in blocks.groupBy("token").agg(F.sum("rows").alias("n")).collect()}
    counts = held.groupBy("token").agg(F.count_distinct("id").alias("n")).collect()
    assert frequencies == {r.token: r.n for r in counts}


def test_slots_reach_the_scan(spark, tmp_path):
    """The words' folder is opened, and of its rows only pages of the slots asked for are read."""
    rows = _many(spark, 3, 3000).select("id", "name", "abstract", "tags", F.lit("").alias("description"), "kind", "item_identifier")
    path = str(tmp_path)
    spark.conf.set("parquet.page.row.count.limit", "200")
    keyword.write_postings(keyword.postings(rows), path, keyword.lengths(rows))
    spark.conf.unset("parquet.page.row.count.limit")
    held = spark.read.parquet(f"{path}/postings")
    slots = held.filter("token = 'w1'").groupBy("slot").count().orderBy("slot").collect()
    some = keyword._of_tokens(held, ["w1"]).filter(F.col("slot").isin([slots[0]["slot"]]))
    assert some.count() == slots[0]["count"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "slot" in plan.split("PushedFilters")[1].split("]")[0] and "EqualTo(token,w1)" in plan.replace("In(token, [w1])", "EqualTo(token,w1)")


def test_postings_make_one_exchange_and_no_row_twice(spark):
    rows = _many(spark, 4, 50)
    found = keyword.postings(rows)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    plan = keyword.dealt(found, 51, 10_000_000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert [keyword.buckets_for(n) for n in (0, 8_000_000, 8_000_001, 100_000_000, 10**14)] == [1, 1, 2, 16, 1 << 14]


WORDS = ["tiếng", "Việt", "re\u0301sume\u0301", "résumé", "ΚΑΛΗΜΈΡΑ", "καλημέρας", "हिन्दी", "नमस्ते", "İstanbul", "istanbul", "STRASSE", "straße", "ẞ", "日本語", "ǅ", "Ǖ", "naïve", "Å", "ﬁn", "x\u0300\u0301y", "Ещё", "еще"]


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.sampled_from(WORDS), st.text(st.characters(codec="utf-8", categories=["Ll", "Lu", "Lo", "Mn", "Nd", "Po"], max_codepoint=0x1FFF), min_size=1, max_size=4)), min_size=1, max_size=6))
def test_folding_equals_fts(words):
    """Every word must find what FTS5 finds by it, on the side of the query and on that of the text."""
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x)")
    db.execute("create virtual table v using fts5vocab(t, 'instance')")
    db.execute("insert into t values (?)", (" ".join(words),))
    want = [r[0] for r in db.execute("select term from v order by offset")]
    assume(all(unicodedata.category(c) != "Cn" and _old(c) for w in words for c in w))
    assert [t for p in phrases_of(" ".join(words)) for t in p] == want


def _old(c):
    """Assigned in both tables: SQLite's are of Unicode 6.1."""
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x)")
    db.execute("create virtual table v using fts5vocab(t, 'row')")
    db.execute("insert into t values (?)", (f"q{c}z",))
    terms = {r[0] for r in db.execute("select term from v")}
    inside = unicodedata.category(c)[0] in "LN" or unicodedata.combining(c) and terms == {"qz"}
    return bool(inside) == (len(terms) == 1) and (c.lower() == c or f"q{c}z" not in terms)


def test_texts_fold_like_queries(spark):
    texts = [*WORDS, "Ünïcode MIXED Ж-ж_x", "plain ASCII Words", None, ""]
    got = [r[0].split() for r in spark.createDataFrame([(t,) for t in texts], "t string").select(spaced_tokens(F.col("t"))).collect()]
    assert got == [[t for p in phrases_of(x or "") for t in p] for x in texts]


def test_words_beyond_latin_are_found(spark):
    rows = [("1", "tiếng Việt re\u0301sume\u0301"), ("2", "नमस्ते हिन्दी"), ("3", "ΚΑΛΗΜΈΡΑ κόσμε")]
    tokens = keyword.index(spark.createDataFrame(rows, "id string, name string"), {"name": 1.0})
    found = {q: [r.id for r in keyword.search(tokens, q, weights={"name": 1.0}).collect()] for q in ("tiếng", "résumé", "resume", "हिन्दी", "καλημέρα", "ΚΌΣΜΕ")}
    assert found == {"tiếng": ["1"], "résumé": ["1"], "resume": ["1"], "हिन्दी": ["2"], "καλημέρα": ["3"], "ΚΌΣΜΕ": ["3"]}


def test_special_characters_give_nothing(indexed):
    assert keyword.search(indexed, '"-* ():^').count() == 0
    assert phrases_of(" - geo-Feature É ") == [["geo", "feature"], ["e"]]


def test_filter_leaves_scores(indexed):
    every = {r.id: r.relevance for r in keyword.search(indexed, "geo").collect()}
    some = {r.id: r.relevance for r in keyword.search(indexed, "geo", filters=F.col("id") == "b").collect()}
    assert some == {"b": every["b"]}
    assert keyword.search(indexed, "geo", filters=F.col("id") == "zz").count() == 0


def test_name_outranks_description(spark):
    df = spark.createDataFrame([("1", "x", "geo"), ("2", "geo", "x"), ("3", "y", "y")], "id string, name string, description string")
    found = keyword.search(keyword.index(df, {"name": 5.0, "description": 1.0}), "geo", weights={"name": 5.0, "description": 1.0})
    assert [r.id for r in found.collect()] == ["2", "1"]


def test_phrase_that_overlaps_itself(spark):
    df = spark.createDataFrame([("1", "a a a"), ("2", "b"), ("3", "c")], "id string, name string")
    tokens = keyword.index(df, {"name": 1.0})
    assert tokens.select(keyword.occurrences(F.col("t_name"), ["a", "a"])).first()[0] == 2


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("k1", "i1", "item_core", "o", "schema", "geo feature"), ("k2", "i1", "item_usage", "o", "schema", "feature"), ("k3", "i2", "item_core", "o", "model", "geo"), ("k4", "i3", "item_core", "p", "model", "none of them")]
    df = spark.createDataFrame(rows, "chunk_key string, item_id string, chunk_type string, org string, item_class string, text string")
    return embed(df, KeywordPresence(("geo", "feature", "sensor", "unrelated"))).cache()


def test_nearest_filters_first(chunks):
    query = [1.0, 1.0, 0.0, 0.0]
    assert [r.item_id for r in vector.nearest(chunks, query, filters=F.col("org") == "o", chunk_types=["item_core"]).collect()] == ["i1", "i2"]
    assert [r.item_id for r in vector.nearest(chunks, query, limit=1, filters=F.col("item_class") == "model").collect()] == ["i2"]
    assert vector.nearest(chunks, [0.0] * 4).count() == 0  # no direction, no distance
    best = {r.item_id: (round(r.distance, 6), r.matched_chunk_types) for r in vector.best_per_item(vector.nearest(chunks, query)).collect()}
    assert best["i1"] == (0.0, ["item_core", "item_usage"]) and "i3" not in best


def test_top_n_is_taken_on_tasks(chunks, indexed):
    for df in (vector.nearest(chunks, [1.0, 0, 0, 0]), keyword.search(indexed, "geo")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan


def _keyword(spark, rows):
    return spark.createDataFrame(rows, "item_id string, relevance double")


def test_fusion_puts_double_hits_first(spark, chunks):
    words = _keyword(spark, [("i2", 1.0), ("zz", 0.5)])
    rows = hybrid.hybrid_search(words, lambda q: vector.nearest(chunks, q), lambda t: [1.0, 0.0, 0.0, 0.0], "geo").collect()
    assert [r.item_id for r in rows] == ["i2", "i1", "zz"] and rows[0].number_matched == 3
    assert rows[0].score == pytest.approx(0.75 + 0.25 * 0.5)


def test_strict_and_failing_embedder_are_keyword_only(spark, chunks):
    words = _keyword(spark, [("i2", 1.0)])

    def down(text):
        raise OSError("no server")

    for rows in (hybrid.hybrid_search(words, lambda q: vector.nearest(chunks, q), down, "geo").collect(), hybrid.hybrid_search(words, lambda q: vector.nearest(chunks, q), down, "geo", strict=True).collect()):
        assert [(r.item_id, r.score, r.matched_chunk_types, r.number_matched) for r in rows] == [("i2", 0.5, [], 1)]


def test_paging_and_boost(spark):
    scored = spark.createDataFrame([("a", 0.9), ("b", 0.5), ("c", 0.5)], "item_id string, score double")
    rows = hybrid.ranked(scored, limit=1, offset=1).collect()
    assert [(r.item_id, r["rank"], r.number_matched) for r in rows] == [("b", 2, 3)]
    boosted = hybrid.boost_terms(scored, spark.createDataFrame([("a", 1.0)], "item_id string, match double"))
    assert {r.item_id: round(r.score, 3) for r in boosted.collect()} == {"a": 1.0, "b": 0.5, "c": 0.5}


def test_scalar_functions(spark):
    df = spark.createDataFrame([("bblocks://x.y", "o/r/s", "ÀéÎ Straße")], "t string, r string, s string")
    row = df.select(strip_scheme(F.col("t")), org_of_register(F.col("r")), fold(F.col("s")), keyword_score(F.lit(3.0)), semantic_score(F.lit(1.5)), row_id(F.lit("k"))).first()
    import hashlib

    want = int.from_bytes(hashlib.sha1(b"k").digest()[:8], "big") & (1 << 63) - 1
    assert tuple(row) == ("x.y", "o", "aei straße", 0.75, 0.0, want)


@pytest.mark.parametrize("seed", [1, 2])
def test_cells_find_what_a_full_scan_finds(spark, tmp_path, monkeypatch, seed):
    """Clustered vectors, copies, zero and null ones; every query is exact, and near ones read few cells."""
    from meridian.operators import vector

    monkeypatch.setattr(vector, "CELL_ROWS", 20)
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)], f"t{i % 3}") for i in range(600)]
    rows += [(600 + i, rows[i][1], "t0") for i in range(40)] + [(700, [0.0] * 6, "t0"), (701, None, "t1")]
    df = spark.createDataFrame(rows, "chunk_key long, embedding array<float>, chunk_type string").repartition(3)
    kept = vector.write_cells(df, str(tmp_path))
    assert kept.chunks().count() == 640 and kept.cells().agg(F.sum("rows")).first()[0] == 640
    seen = []
    queries = [rows[3][1], centres[0], [-x for x in centres[1]], [rng.gauss(0, 1) for _ in range(6)], [1.0, 0, 0, 0, 0, 0]]
    for query in queries:
        for how in ({"limit": 5}, {"limit": 30, "filters": F.col("chunk_key") % 2 == 0}, {"limit": 7, "chunk_types": ["t2"]}, {"limit": 1000}):
            want = [(r.chunk_key, round(r.distance, 12)) for r in vector.nearest(df, query, **how).collect()]
            got = vector.nearest_in_cells(kept, query, report=seen.append, **how)
            assert [(r.chunk_key, round(r.distance, 12)) for r in got.collect()] == want and set(got.columns) == {*df.columns, "distance"}
    assert seen[0]["read"] < seen[0]["cells"] // 2 and seen[3]["read"] == seen[3]["cells"]
    plan = vector.nearest_in_cells(kept, queries[0], limit=5)._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert vector.nearest_in_cells(kept, [0.0] * 6).count() == 0 and vector.nearest_in_cells(kept, []).count() == 0
