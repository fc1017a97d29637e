import hashlib
import random
import re

import duckdb
import pytest

from meridian.llm import fill_in_middle as fim

from .conftest import prose


def expected(doc_id, text, seed=42, percent=50, spm_percent=80):
    """From the definition, over code points."""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < spm_percent:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows_of(df):
    return sorted((r["doc_id"] is None, r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) for r in df.collect())


def wanted(rows, **how):
    sha = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    return sorted((i is None, i, *e[:4], sha(e[4]), sha(t)) for i, t in rows for e in [expected(i, t, **how)])


@pytest.mark.parametrize("how", [{}, {"percent": 100, "spm_percent": 0}, {"percent": 100, "spm_percent": 100, "seed": 7}])
def test_hard_rows_equal_the_definition_and_come_back(spark, hard, how):
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    assert rows_of(fim.digest(fim.transform(hard, **how))) == wanted(rows, **how)


def test_random_texts_with_delimiters_escapes_and_sentinels(spark):
    rng = random.Random(11)
    pieces = ["a", " ", "\n", "\x01", "\x02", "\x02d", "\x02e", "é", "𝒳", "<P>", "<", "S>", "<S", "M>", "\t\t", "\x00", "$1", "\\", "\x85", " ", " "]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(fim.digest(fim.transform(df, percent=100))) == wanted(rows, percent=100)
    forms = {r[0] for r in fim.transform(df, percent=100).select("form").collect()}
    assert forms == {"plain", "psm", "spm"}


def test_parts_join_to_the_text(spark, hard):
    got = fim.transform(hard, percent=100).where("form <> 'plain'").collect()
    assert got and all(r["prefix"] + r["middle"] + r["suffix"] == r["text"] for r in got)


def test_sql_says_the_same(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(0, 40)) + rng.choice(["", "\n", " <M> ", "日本"])) for i in range(200)] + [(None, "no id"), (5, None), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    got = fim.digest(fim.transform(df))
    order = got.columns
    want = con.sql(f"SELECT {', '.join(order)} FROM ({fim.oracle_sql()})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())


def test_nothing_of_nothing_and_no_python(spark, empty):
    assert fim.digest(fim.transform(empty)).collect() == []
    plan = fim.digest(fim.transform(empty))._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Exchange" not in plan
