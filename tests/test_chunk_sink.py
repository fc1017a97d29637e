"""The vector store as a sink: commits, aborts, repeats."""

import os
import random

import pytest
from pyspark.sql import functions as F

from meridian.operators import vector
from meridian.sources import chunk_sink as sink

COLUMNS = "chunk_key string, register_id string, chunk_type string, embedding array<float>"


def rows(spark, *keys, register="r", value=1.0):
    return spark.createDataFrame([(k, register, "item_core", [value, float(i + 1)]) for i, k in enumerate(keys)], COLUMNS)


def files(path):
    return sorted(os.listdir(path / "data")) if (path / "data").exists() else []


def test_upsert_delete_and_search_equal_a_dictionary(spark, tmp_path):
    store, rng, want = sink.ChunkStore(spark, str(tmp_path), COLUMNS), random.Random(1), {}
    assert store.current().count() == 0
    for step in range(6):
        if step in (2, 4):
            gone = rng.choice("ab")
            store.delete_where(F.col("register_id") == gone)
            want = {k: v for k, v in want.items() if v[0] != gone}
        else:
            some = {f"k{n}": (rng.choice("ab"), "item_core", [rng.gauss(0, 1), rng.gauss(0, 1)]) for n in rng.sample(range(12), 5)}
            store.upsert(spark.createDataFrame([(k, *v) for k, v in some.items()], COLUMNS).repartition(2))
            want |= some
        got = {r.chunk_key: r.register_id for r in store.current().collect()}
        assert got == {k: v[0] for k, v in want.items()}, step
    plain = spark.createDataFrame([(k, *v) for k, v in want.items()], COLUMNS)
    ask = lambda df: [(r.chunk_key, round(r.distance, 9)) for r in df.collect()]
    near = ask(vector.nearest(plain, [1.0, 0.5], limit=4))
    assert ask(store.search([1.0, 0.5], limit=4)) == near
    store.compact()
    assert ask(store.search([1.0, 0.5], limit=4)) == near and files(tmp_path) == sorted(sink.manifest(str(tmp_path))["files"])
    assert "Aggregate" not in store.current()._jdf.queryExecution().executedPlan().toString()


def test_a_failing_job_leaves_nothing(spark, tmp_path):
    store = sink.ChunkStore(spark, str(tmp_path), COLUMNS)
    store.upsert(rows(spark, "a", "b"))
    before, held = files(tmp_path), sink.manifest(str(tmp_path))
    broken = rows(spark, *"cdefgh").repartition(3).withColumn("register_id", F.when(F.col("chunk_key") == "f", F.raise_error(F.lit("lost"))).otherwise(F.col("register_id")))
    with pytest.raises(Exception):  # noqa: B017
        store.upsert(broken)
    assert files(tmp_path) == before and sink.manifest(str(tmp_path)) == held
    assert {r.chunk_key for r in store.current().collect()} == {"a", "b"}


def test_an_abort_takes_away_what_killed_and_late_tasks_wrote(spark, tmp_path):
    """No message names their files; what an earlier batch of the same writer committed stays."""
    schema = rows(spark).withColumn("deleted", F.lit(False)).schema
    batch = rows(spark, "a").withColumn("deleted", F.lit(False)).toArrow().to_batches()
    writer = sink.ChunkStreamWriter(sink._Files({"path": str(tmp_path), "stream": "s"}, schema))
    writer.commit([writer.write(iter(batch))], 0)
    before = files(tmp_path)
    writer.write(iter(batch))

    def late():
        yield from batch
        writer.abort([None, None], 1)
        assert files(tmp_path) == before

    for rest in (late(), iter(batch)):
        with pytest.raises(InterruptedError):
            writer.write(rest)
        assert files(tmp_path) == before == sorted(sink.manifest(str(tmp_path))["files"])
    again = sink.ChunkStreamWriter(sink._Files({"path": str(tmp_path), "stream": "s"}, schema))
    again.commit([again.write(iter(batch))], 1)
    assert len(files(tmp_path)) == 2
    sink.ChunkStore(spark, str(tmp_path), COLUMNS).compact()
    assert not os.listdir(tmp_path / "aborted") and len(files(tmp_path)) == 1


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    options = {"path": str(tmp_path), "stream": "s"}
    schema = rows(spark).withColumn("deleted", F.lit(False)).schema
    batch = rows(spark, "a").withColumn("deleted", F.lit(False)).toArrow().to_batches()
    writer = sink.ChunkStreamWriter(sink._Files(options, schema))
    for _ in range(2):
        writer.commit([writer.write(iter(batch)), None], 0)
        assert len(files(tmp_path)) == 1 and sink.manifest(str(tmp_path))["version"] == 1
    other = sink.ChunkStreamWriter(sink._Files({**options, "stream": "t"}, schema))
    other.commit([other.write(iter(batch))], 0)
    assert sink.manifest(str(tmp_path))["batches"] == {"s": 0, "t": 0} and len(files(tmp_path)) == 2
    message = writer.write(iter(batch))
    writer.abort([message, None], 1)
    assert len(files(tmp_path)) == 2


def test_a_stream_puts_chunks_in(spark, tmp_path):
    landing, store = str(tmp_path / "in"), sink.ChunkStore(spark, str(tmp_path / "store"), COLUMNS)
    for keys, value in ((("a", "b"), 1.0), (("b", "c"), 5.0)):
        rows(spark, *keys, value=value).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(COLUMNS).parquet(landing)
        store.upsert_stream(stream, str(tmp_path / "cp"), "chunks").trigger(availableNow=True).start().awaitTermination()
    assert {r.chunk_key: r.embedding[0] for r in store.current().collect()} == {"a": 1.0, "b": 5.0, "c": 5.0}
