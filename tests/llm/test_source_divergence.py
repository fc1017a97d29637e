import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from meridian.llm import source_divergence as sd

from .conftest import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, least, top=50):
    """From the definition, in whole numbers of any size."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
        groups[lang].add(source)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        v = len(kept)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        share = lambda n, all_, v=v: 1 + 10**9 * (n + 5) // (all_ + 5 * v)
        p = {s: {t: share(counts[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def found(df, **how):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in sd.divergences(df, **how).collect())


SCHEMA = "doc_id long, text string, lang string, source string, term string, shard int, n long"


def table_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, *r, "x", 1, 2) for i, r in enumerate(rows)], SCHEMA).repartition(parts)


def random_rows(rng, n):
    words = [prose(rng, 1) for _ in range(40)] + ["Ünï", "日本語", "ÀB", "a1b", "É", "x"]
    rows = []
    for _ in range(n):
        text = " ".join(rng.choice(words) if rng.random() < 0.8 else rng.choice(words[:4]).upper() for _ in range(rng.randint(0, 30)))
        rows.append((rng.choice([text, text, text, "", None]), rng.choice(["en", "en", "de", None, ""]), rng.choice(["hot", "hot", "hot", "s1", "s2", "", None])))
    return rows


@pytest.mark.parametrize(("seed", "least"), [(1, 1), (2, 5), (3, 30), (4, 10_000)])
def test_random_tables_equal_the_definition(spark, seed, least):
    rows = random_rows(random.Random(seed), 300)
    assert found(table_of(spark, rows), least=least) == expected(rows, least)


def test_many_shards_flushes_and_stretches_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    rows = random_rows(rng, 200) + [(prose(rng, 30_000), "en", "long"), ("Abc " * 5000 + "x\x00y", "en", "s1")]
    monkeypatch.setattr(sd, "SHARD", 50)
    monkeypatch.setattr(sd, "HELD", 40)
    monkeypatch.setattr(sd._parts, "__defaults__", (2000,))
    assert found(table_of(spark, rows), least=3) == expected(rows, 3)


def test_blocks_that_end_inside_a_term_change_nothing(spark, monkeypatch):
    rows = random_rows(random.Random(11), 300) + [("hot " * 50, "en", f"s{i}") for i in range(90)]
    monkeypatch.setattr(sd, "HELD", 20)
    monkeypatch.setattr(sd, "BLOCK", 15)
    assert found(table_of(spark, rows), least=3) == expected(rows, 3)


def test_a_large_partition_is_summed_in_little_memory(spark, monkeypatch):
    small = {"threads": 1, "memory_limit": "24MB", "temp_directory": "", "preserve_insertion_order": False}
    monkeypatch.setattr(sd, "_session", lambda: duckdb.connect(config=small))
    monkeypatch.setattr(sd, "BLOCK", 5000, raising=False)
    each = ["'en' AS lang", "concat('a term of some length ', id % 400000) AS term", "10L AS docs", "array('s', concat('source ', id % 2)) AS sources", "array(1L, 2L) AS counts"]
    kept = sd.kept_counts(spark.range(0, 1_200_000, 1, 8).selectExpr(*each), 30)
    assert kept.selectExpr("count(*)", "sum(n)", "sum(first)").first()[:] == (800_000, 3_600_000, 400_000)


def test_hard_rows_and_a_top_of_two(spark, hard):
    rows = [(r["text"], r["lang"], r["source"]) for r in hard.collect()]
    assert found(hard, least=2, top=2) == expected(rows, 2, 2)


def test_nothing_of_nothing(spark, empty):
    assert found(empty) == []


def test_sql_says_the_same(spark):
    rows = random_rows(random.Random(5), 300)
    df = table_of(spark, rows)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    want = con.sql(f"SELECT lang, source, part, item, value, rank FROM ({sd.oracle_sql(4)})").fetchall()
    assert sorted(want) == found(df, least=4) == expected(rows, 4)
