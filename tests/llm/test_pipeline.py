import math
import subprocess
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from meridian.llm import near_dedup, pii, quality_classifier, quality_rules, queries
from meridian.session import ship

from . import test_near_dedup, test_packing, test_pii, test_scores

DATA = "/root/testdata/sf0.001"


def test_whole_pipeline_equals_brute_force(spark):
    """Every stage anew with plain dictionaries and sets, from the tables to the tokens that are packed."""
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    marks = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = {r.doc_id: r.text or "" for r in documents.collect()}
    pairs = quality_classifier.sample(documents, marks)
    _, learned = quality_classifier.trained([t for t, _ in pairs], [q for _, q in pairs])
    rows = {i: t for i, t in rows.items() if test_scores.brute_score(learned, t) >= 0.7}

    good = {r.doc_id for r in marks.where("quality = 1").collect()}
    raw, target, own = Counter(), Counter(), {}
    for i, text in rows.items():
        b = text.encode()
        own[i] = [int.from_bytes(b[k : k + 4], "little") * 0x9E3779B1 % 2**32 >> 16 for k in range(len(b) - 3)]
        raw.update(own[i])
        target.update(own[i] if i in good else [])
    n, m = sum(raw.values()), sum(target.values())
    ratio = {g: math.log((target[g] + quality_rules.PRIOR) / (c / n * m + quality_rules.PRIOR)) for g, c in raw.items()}

    def passes(i, text):
        words, _, _, _, repeats = test_scores.brute_counts(text)
        return words >= 10 and 100 * repeats <= 20 * words and sum(map(ratio.get, own[i])) / max(1, len(own[i])) >= quality_rules.THRESHOLD

    rows = {i: t for i, t in rows.items() if passes(i, t)}
    rows = {i: rows[i] for i, (_, _, kept) in test_near_dedup.brute(list(rows.items()), 5).items() if kept}
    terms = test_pii.brute_disclosing(rows.values())

    def cleaned(text):
        base = test_pii.brute(text)
        spans = base + pii.secret_spans(text, base)
        places = [x.span() for x in pii._WORD.finditer(text) if x.group().lower() in terms]
        return pii.clean(text, [(a, b) for a, b in places if not any(x < b and a < y for _, x, y in spans)])

    texts = {i: cleaned(t) for i, t in rows.items()}
    ids = {i: b + b"\x01\0\0\0" for i, b in zip(texts, test_packing.library(list(texts.values())), strict=True)}
    packed = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in packed} == set(rows) and 0 < len(rows) < documents.count()
    used = test_packing._check(packed, ids, 4096)
    floor = -(-sum(len(b) // 4 for b in ids.values()) // 4096)
    assert floor <= used <= floor + 1  # the floor leaves 45 of 147,456 places free


def test_stages_with_hard_rows(spark, hard, empty):
    """Nulls, empty, long and repeated rows, clashing columns, and empty tables, in every stage by itself."""
    for name, stage in corpus_pipeline.STAGES:
        for docs in (hard, empty):
            out = stage(ship(spark), docs, DATA)
            rows = out.collect()
            assert out.columns == docs.columns or name == "best-fit packing", name
            assert len(rows) <= docs.count() or name == "best-fit packing", name
    kept = {name: stage(spark, hard, DATA) for name, stage in corpus_pipeline.STAGES[:-1]}
    assert kept["pii sanitisation"].count() == hard.count() and kept["pii sanitisation"].where("text is null").count() == 1
    assert kept["minhash near-dedup"].where("doc_id is null or text is null or text = ''").count() == 3
    assert kept["quality rules"].where("coalesce(text, '') = ''").count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    got, want = queries.queries()[name](ship(spark), DATA), con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(repr([r[c] for c in columns]) for r in got.collect())
    assert rows == sorted(repr([r[want.columns.index(c)] for c in columns]) for r in want.fetchall())


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    marks = spark.read.parquet(f"{DATA}/labels.parquet")
    columns = docs.columns
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(ship(spark), docs, DATA).cache()
        assert docs.columns == columns
        kept.append({r.doc_id for r in docs.collect()})
    first = spark.read.parquet(f"{DATA}/documents.parquet")
    assert kept[0] == {r.doc_id for r in quality_classifier.classify(first, marks).where("predicted = 1").collect()}
    good = first.where(F.col("doc_id").isin(list(kept[0])))
    assert kept[1] == {r.doc_id for r in quality_rules.apply_rules(good, marks).where("kept").collect()}
    rest = first.where(F.col("doc_id").isin(list(kept[1])))
    assert kept[2] == {r.doc_id for r in near_dedup.near_duplicates(rest).where("kept").collect()}
    assert kept[3] == kept[2] and not any(pii.base_spans(r.text) for r in docs.collect())
    packed = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == kept[3]


def test_every_operator_has_one_query():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("gone", ["corpus_pipeline", "public_tokenizers", "sentencepiece"])
def test_entry_takes_what_can_be_imported(gone):
    code = f"gone = {gone!r}" + """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == gone or name.startswith(gone + "."):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = list(e.queries())
assert len(names) > 40 and ("pipeline" in names) == (gone == "sentencepiece"), names
assert any(n.startswith("op1") for n in names) == (gone != "public_tokenizers"), names
assert set(e.oracle_sql()) <= set(names)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[2], timeout=120)
