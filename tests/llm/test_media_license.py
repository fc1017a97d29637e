import hashlib
import os
import random
import re
import textwrap
import wave
import zlib
from collections import Counter
from io import BytesIO

import duckdb
import numpy as np
import pytest

from meridian.llm import license_scan as ls
from meridian.llm import media

from .conftest import prose


def test_wav_is_one_and_reads_back():
    payload = media.payload_of(b"abc")
    assert len(payload) == 576 and payload.endswith(b"\xff") and media.payload_of(b"x" * 576) == b"x" * 576
    with wave.open(BytesIO(media.wav(payload))) as f:
        assert (f.getnchannels(), f.getsampwidth(), f.readframes(f.getnframes())) == (1, 1, payload)
    assert media.samples(media.wav(payload)) == payload
    with pytest.raises(ValueError):
        media.samples(media.wav(payload)[:-1])


def test_gear_equals_the_loop():
    data = np.random.default_rng(1).integers(0, 256, 500).astype(np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(media._GEAR[b])) % 2**32
        want.append(h)
    assert media.gear(data).tolist() == want


def test_chunks_join_and_survive_insertions():
    rng = random.Random(2)
    text = prose(rng, 20_000).encode()
    a, b = media.chunked(text), media.chunked(b"inserted at the head " + text)
    assert b"".join(d for _, d in a) == text and all(media.LEAST <= len(d) <= media.MOST for _, d in a[:-1])
    assert len({d for d, _ in a} & {d for d, _ in b}) > 0.8 * len(a)


def test_cuts_do_not_depend_on_stretches(monkeypatch):
    data = prose(random.Random(3), 900_000).encode()  # longer than a stretch
    marks = np.flatnonzero(media.gear(np.frombuffer(data, np.uint8)) >> np.uint32(32 - media.MASK_BITS) == 0) + 1
    out, begin = [], 0
    while begin < len(data):
        later = marks[marks >= begin + media.LEAST]
        begin = min(int(later[0]) if len(later) else len(data), begin + media.MOST, len(data))
        out.append(begin)
    assert len(data) > 1 << 22 and media.cuts(data) == out


def expected(text):
    """By the standard library's own writer of sound files, and sample by sample."""
    data = (text or "").encode()
    payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
    held = BytesIO()
    with wave.open(held, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(media.RATE)
        f.writeframes(payload)
    stored = held.getvalue()
    n, mean = len(payload), sum(payload) / len(payload)
    deviation = (sum(b * b for b in payload) * n - sum(payload) ** 2) ** 0.5 / n
    crossings = sum((a < 128) != (b < 128) for a, b in zip(payload, payload[1:]))  # noqa: B905
    bins = [sum(b // 16 == k for b in payload) for k in range(16)]
    feature = f"{mean:.4f};{deviation:.4f};{crossings};" + ",".join(map(str, bins))
    return (n and len(data), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature)


COLUMNS = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def test_round_trip_with_shared_chunks(spark):
    rng = random.Random(6)
    base = prose(rng, 5000)
    texts = [base, base, base + " x", prose(rng, 3000) + base, prose(rng, 10), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in media.media_features(docs).collect()}
    assert got == {i: expected(t) for i, t in enumerate(texts)}
    stored = media.store(docs)
    distinct = stored.where("digest is not null").select("digest").distinct().count()
    listed = stored.where("digest is null").selectExpr("explode(away) as i").count()
    assert 0 < distinct < listed


def test_slots_are_the_same_in_spark(spark):
    digests = [random.Random(i).randbytes(16) for i in range(2000)]
    rows = spark.createDataFrame([(d,) for d in digests], "d binary").select("d", media.slot_column("d", 1 << 23).alias("slot")).collect()
    assert len(rows) == 2000 and all(r.slot == media._slot(bytes(r.d), 1 << 23) for r in rows)


def test_repeated_chunks_have_one_owner(spark):
    rng = random.Random(9)
    bases = [prose(rng, 1500) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate([*bases, *bases, *bases, *(prose(rng, 300) for _ in range(20))])), "doc_id long, text string").repartition(4)
    counts = Counter(d for r in docs.collect() for d, _ in media.chunked(media.wav(media.payload_of(r.text.encode()))))
    repeated = {d for d, n in counts.items() if n > 1}
    stored = media.store(docs).collect()
    files, owners = [r for r in stored if r.digest is None], {bytes(r.digest) for r in stored if r.digest is not None}
    assert len(repeated) > 100 and repeated <= owners
    for r in files:  # a file keeps no chunk of its own that another place has
        assert {i for i, d in enumerate(r.digests) if bytes(d) in repeated} <= set(r.away)
        assert len(media._own_parts(bytes(r.own))) == len(r.digests) - len(r.away)


def test_media_hard_rows(hard, empty):
    got = sorted(tuple(r[c] for c in COLUMNS) for r in media.media_features(hard).collect())
    assert got == sorted(expected(r.text) for r in hard.collect())
    assert media.media_features(empty).count() == 0


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_scan(text):
    w = words(text or "")
    places, labels = [], set()
    for phrase, label in ls.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    best, more = 0.0, set()
    for line in (text or "").split("\n"):
        own = set(words(line))
        for name, t in ls.template_words(ls.TEMPLATES).items():
            share = len(own & set(t)) / len(t)
            if len(own & set(t)) >= ls.needed(len(t), ls.THRESHOLD):
                more.add(name)
                best = max(best, share)
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more)), 1.0 if places else best)


FIELDS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
TEXTS = [
    "Released under the MIT License. cc by cc-by CC  BY, gnu general public license apache license", "the GNU General\nPublic License", "mit-license mit éLicense", "cc byte by cc",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "licensed under apache 2.0 version the", ls.TEMPLATES["gpl-notice"].upper() + " and more", "MIT LİCENSE mıt license K",
]


def test_scan_equals_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: tuple(r[c] for c in FIELDS) for r in ls.scan(docs).collect()}
    assert got == {i: brute_scan(t) for i, t in enumerate(TEXTS)}


def wrapped_matches(text):
    """Labels and best share of the blocks over line ends, by brute force."""
    w, found = words(text), {}
    for name, t in ls.TEMPLATES.items():
        own, width = set(words(t)), ls.template_widths(ls.TEMPLATES, ls.THRESHOLD)[name]
        most = max((len(own & set(w[i : i + width])) for i in range(len(w))), default=0)
        if most >= ls.needed(len(own), ls.THRESHOLD):
            found[name] = most / len(own)
    return found


def test_scan_finds_wrapped_notices(spark):
    rng = random.Random(8)
    texts = {}
    for i, t in enumerate(ls.TEMPLATES.values()):
        for j, (columns, mark) in enumerate([(30, ""), (72, " * "), (78, "dnl ")]):
            notice = "\n".join(mark + line for line in textwrap.wrap(t, columns))
            texts[10 * i + j] = "\n".join([prose(rng, rng.randint(0, 90)), notice, prose(rng, 300)])
    w = ls.TEMPLATES["bsd-conditions"].split()
    texts[900] = "\n".join(x + " " + prose(rng, 40) for x in w)  # its words, far from each other
    texts[901] = ("\n".join(textwrap.wrap(" ".join(w[:16]), 40)) + "\n") * 3 + prose(rng, 50)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in ls.scan(docs).collect()}
    for i, name in enumerate(ls.TEMPLATES):
        assert all(name in got[10 * i + j].labels.split(",") for j in range(3)), name
    for i, text in texts.items():
        over, base = wrapped_matches(text), brute_scan(text)
        assert set(got[i].labels.split(",")) - {""} == (set(base[5].split(",")) | set(over)) - {""}, text
        assert got[i].score == max(base[6], *over.values(), 0.0, 0.0)
    assert got[900].labels == ""


def test_scan_runs_no_python(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    plan = ls.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow", plan) and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scan_hard_rows(hard, empty):
    got = sorted((tuple(r[c] for c in FIELDS) for r in ls.scan(hard).collect()), key=repr)
    assert got == sorted((brute_scan(r.text) for r in hard.collect()), key=repr)
    assert ls.scan(empty).count() == 0 and ls.template_matches(hard, {}).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_scan_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(ls.oracle_sql())
    got = ls.scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    columns = sorted(got.columns)
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr([r[want.columns.index(c)] for c in columns]) for r in want.fetchall())
