"""Ownership as state of a stream, against the batch form and a plain loop."""

import random

import pytest

from meridian.streaming import ownership as own


def plain(batches):
    """Claims and owners by the definition, one document after another."""
    marker, held, since = {}, {}, {}
    for seq, docs in enumerate(batches):
        for register, (modified, items) in docs.items():
            if items is None or (register in marker and marker[register] == modified):
                continue
            now = {i for i in items if i}
            for item in held.get(register, set()) - now:
                del since[item, register]
            for item in now - held.get(register, set()):
                since[item, register] = seq
            held[register], marker[register] = now, modified
    owner = {}
    for (item, register), at in since.items():
        owner[item] = min(owner.get(item, (at, register)), (at, register))
    return since, {item: register for item, (_, register) in owner.items()}


def random_batches(rng, n, registers="abc", items="vwxyz"):
    out = []
    for _ in range(n):
        docs = {}
        for register in rng.sample(registers, rng.randint(0, len(registers))):
            claimed = None if rng.random() < 0.1 else [*rng.sample(items, rng.randint(0, 4)), *rng.choice([[], [""], [None], ["v", "v"]])]
            docs[register] = (rng.choice(["1", "2", "3", None]), claimed)
        out.append(docs)
    return out


def rows_of(batches):
    return [(r, seq, m, i) for seq, docs in enumerate(batches) for r, (m, i) in docs.items()]


@pytest.mark.parametrize("seed", range(3))
def test_batch_form_equals_the_loop(spark, seed):
    batches = random_batches(random.Random(seed), 12)
    since, owners = plain(batches)
    got = own.standing_claims(spark.createDataFrame(rows_of(batches), own.DOCUMENTS).repartition(3)).collect()
    assert {(r.item_id, r.register_id): r.since for r in got} == since
    assert {r.item_id: r.owner for r in got} == owners


def streamed(spark, folder, checkpoint, out):
    """Both states in one query, restarted for each call."""
    docs = spark.readStream.schema(own.DOCUMENTS).option("maxFilesPerTrigger", 1).parquet(str(folder))
    changes = own.owner_changes(own.register_changes(docs))
    query = changes.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def test_an_owner_that_gives_up_hands_over_without_a_new_document(spark, tmp_path):
    """Over restarts, and equal to the batch form on the documents so far; the next claimant sends nothing."""
    folder, out = tmp_path / "in", tmp_path / "out"
    batches = [{"b": ("1", ["x", "y"]), "c": ("1", ["x"])}, {"a": ("1", ["x"])}, {"b": ("1", ["gone"])}, {"b": ("2", ["y"])}, {"c": ("2", []), "a": ("2", ["x", "z"])}]
    for n, docs in enumerate(batches):
        spark.createDataFrame([(r, n, m, i) for r, (m, i) in docs.items()], own.DOCUMENTS).coalesce(1).write.mode("append").parquet(str(folder))
        streamed(spark, folder, tmp_path / "cp", out)
        got = {r.item_id: r.owner for r in own.current_owners(spark.read.schema(own.OWNERS).parquet(str(out))).collect()}
        assert got == plain(batches[: n + 1])[1], n
        if n == 3:
            assert got["x"] == "c"  # b gave x up; c had asked second and is heard now
    log = {(r.item_id, r.seq): (r.before, r.owner) for r in spark.read.schema(own.OWNERS).parquet(str(out)).collect()}
    assert log["x", 3] == ("b", "c") and log["x", 4] == ("c", "a") and log["y", 0] == (None, "b") and ("y", 2) not in log


def test_random_sequences_of_the_stream_equal_the_batch_form(spark, tmp_path):
    batches = random_batches(random.Random(7), 6)
    folder = tmp_path / "in"
    for n, docs in enumerate(batches):
        spark.createDataFrame([(r, n, m, i) for r, (m, i) in docs.items()], own.DOCUMENTS).coalesce(1).write.mode("append").parquet(str(folder))
    streamed(spark, folder, tmp_path / "cp", tmp_path / "out")
    got = {r.item_id: r.owner for r in own.current_owners(spark.read.schema(own.OWNERS).parquet(str(tmp_path / "out"))).collect()}
    whole = own.standing_claims(spark.createDataFrame(rows_of(batches), own.DOCUMENTS)).collect()
    assert got == {r.item_id: r.owner for r in whole} == plain(batches)[1]
