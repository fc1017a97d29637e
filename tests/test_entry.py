"""The registered queries against their SQL, and the entry without the corpus operators."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from meridian.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, db, name):
    got, want = catalog.QUERIES[name](spark, DATA), db.sql(catalog.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(repr([r[c] for c in columns]) for r in got.collect())
    assert rows == sorted(repr([r[want.columns.index(c)] for c in columns]) for r in want.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_the_corpus_operators():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "meridian.llm" or name.startswith("meridian.llm.") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = list(e.queries())
assert len(names) > 40 and not any(n.startswith("op1") or n == "pipeline" for n in names), names
assert set(e.oracle_sql()) <= set(names)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1], timeout=120)


def test_filters_and_columns_reach_the_scan(spark):
    from meridian.operators import browse

    df = browse.by_id(spark.read.parquet(f"{DATA}/part.parquet"), 7, "p_partkey").select("p_name")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p_partkey,7)" in plan and "ReadSchema: struct<p_partkey:bigint,p_name:string>" in plan


@pytest.mark.parametrize("name", ["walk_levels", "hybrid_search", "register_roll_up", "item_graph_nodes", "ingested_items"])
def test_plans_have_no_cross_joins(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_keyword_queries_read_the_buckets_of_their_words(spark):
    plan = catalog.QUERIES["keyword_search"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line and "positions" in line]
    assert scans and all("bucket" in x.partition("PartitionFilters: [")[2].partition("]")[0] and "EqualTo(token,nder)" in x for x in scans)


@pytest.mark.parametrize("name", ["hybrid_search", "strict_search"])
def test_a_single_search_writes_no_index(spark, tmp_path, monkeypatch, name):
    """Nothing is left in the checkpoint folder; where an index is there, it is read, with the same rows."""
    spark.read.parquet(f"{DATA}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/embeddings.parquet").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(catalog, "checkpointed", lambda spark: f"{tmp_path}/kept")
    scanned = catalog.QUERIES[name](spark, str(tmp_path))
    rows = scanned.collect()
    assert rows and not os.path.exists(f"{tmp_path}/kept")
    assert catalog.QUERIES["keyword_search"](spark, str(tmp_path)).count() > 0
    posted = catalog.QUERIES[name](spark, str(tmp_path))
    assert posted.collect() == rows
    assert ["positions" in x._jdf.queryExecution().executedPlan().toString() for x in (scanned, posted)] == [False, True]


def test_every_kind_of_chunk_is_in_the_query(spark):
    kinds = {r[0] for r in catalog.QUERIES["ingested_chunks"](spark, DATA).select("chunk_type").distinct().collect()}
    assert kinds == {"item_core", "item_description", "item_schema", "item_usage", "register_summary"}


def test_changed_documents_give_changed_answers(spark, tmp_path):
    """An index is of the files that are there, not of the folder's name."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("keyword_search", "keyword_top_k"):
        assert catalog.QUERIES[name](spark, str(tmp_path)).count() > 0
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    for name in ("keyword_search", "keyword_top_k", "keyword_index_scan", "document_frequencies"):
        assert catalog.QUERIES[name](spark, str(tmp_path)).count() == 0
