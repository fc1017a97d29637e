"""Media columns stored as content-defined chunks.

A payload becomes the samples of an 8-bit mono WAV file. A rolling gear hash cuts the file where its
content says so, so equal stretches of different files give equal chunks; a digest names each chunk,
Spark joins leave one owner for each digest, and a file is its ordered list of digests. Reading puts
the listed chunks together again and checks every digest.

Chunks that only one file has stay in that file's row of the store, and only chunks that a map of the
shared ones, sized by their number, lets through are dealt out by digest.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import binary_column, discard, filter_bits, mix, sized, sliced, table, texts, tidy

BLOCK, RATE = 576, 8000
LEAST, MOST, MASK_BITS = 512, 16384, 11
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def payload_of(text: bytes) -> bytes:
    """The text's bytes, then bytes 255 up to a positive multiple of the block."""
    return text + b"\xff" * (max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


def wav(payload: bytes) -> bytes:
    """An 8-bit mono PCM file; blocks of 576 keep the data chunk even, as the format wants."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def samples(media: bytes) -> bytes:
    riff, size, kind = struct.unpack_from("<4sI4s", media)
    tag, n = struct.unpack_from("<4sI", media, 36)
    if riff != b"RIFF" or kind != b"WAVE" or tag != b"data" or size != 36 + n or len(media) != 44 + n:
        raise ValueError("not a file this module wrote")
    return media[44:]


def gear(data: np.ndarray) -> np.ndarray:
    """32-bit gear hash at every byte: sum of the last 32 bytes' numbers, each shifted by its age.

    Doubling the window five times gives it without a loop over bytes.
    """
    out = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        further = out.copy()
        further[step:] += out[:-step] << np.uint32(step)
        out = further
    return out


def cuts(media: bytes) -> list[int]:
    """Ends of the chunks: the first place past ``LEAST`` bytes whose hash has its top bits clear, or ``MOST`` bytes."""
    data = np.frombuffer(media, np.uint8)
    found = []
    for at in range(0, len(data), 1 << 22):  # 31 bytes before a stretch decide its first hashes
        low = max(0, at - 31)
        marks = np.flatnonzero(gear(data[low : at + (1 << 22)]) >> np.uint32(32 - MASK_BITS) == 0) + low + 1
        found.append(marks[marks > at])
    marks = np.concatenate(found) if found else np.empty(0, np.int64)
    out, begin, end = [], 0, len(media)
    while begin < end:
        i = int(np.searchsorted(marks, begin + LEAST))
        at = int(marks[i]) if i < len(marks) else end
        at = min(at, begin + MOST, end)
        out.append(at)
        begin = at
    return out


def chunked(media: bytes) -> list[tuple[bytes, bytes]]:
    """``(digest, bytes)`` of each chunk in order."""
    out, begin = [], 0
    for end in cuts(media):
        part = media[begin:end]
        out.append((xxhash.xxh3_128_digest(part), part))
        begin = end
    return out


def feature(payload: bytes) -> str:
    """Mean, deviation, crossings of the middle and a 16-bin histogram of the samples."""
    data = np.frombuffer(payload, np.uint8)
    n = len(data)
    bins = np.bincount(data >> 4, minlength=16)
    total, squares = int(data.sum(dtype=np.int64)), int((data.astype(np.int64) ** 2).sum())
    crossings = int(np.count_nonzero(np.diff(data >= 128)))
    return f"{total / n:.4f};{(max(0, squares * n - total * total) ** 0.5) / n:.4f};{crossings};" + ",".join(map(str, bins.tolist()))


_OUT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"
_OUT_NAMES = [c.split()[0] for c in _OUT.split(", ")]
_OUT_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def _read(n_bytes: int, media: bytes, n_chunks: int) -> tuple:
    payload = samples(media)
    return (n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload), n_chunks)


def _rebuilt(digests: list[bytes], parts: list[bytes]) -> bytes:
    if len(digests) != len(parts) or any(xxhash.xxh3_128_digest(p) != d for d, p in zip(digests, parts, strict=True)):
        raise ValueError("a stored chunk is missing or differs from its digest")
    return b"".join(parts)


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, digests``: the chunks of each file, without their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [[d for d, _ in chunked(wav(payload_of(text)))] for text in binary_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.binary()))], ["doc_id", "digests"])

    return texts(docs).mapInArrow(tidy(run), "doc_id long, digests array<binary>")


def _slot(digest: bytes, bits: int) -> int:
    return int.from_bytes(digest[:4], "little") % bits


def slot_column(digest: str, bits: int) -> Column:
    """``_slot`` in Spark: the first four bytes in reverse, by their hex digits (``reverse`` takes binary for a string)."""
    digits = F.hex(F.substring(digest, 1, 4))
    return F.conv(F.concat(*[F.substring(digits, at, 2) for at in (7, 5, 3, 1)]), 16, 10).cast("long") % bits


def shared_filter(docs: DataFrame) -> np.ndarray:
    """A bit for every digest that occurs more than once: all of these are in it, and few others."""
    found = table(digests(docs).select(F.explode("digests").alias("d")).groupBy("d").agg(F.count("*").alias("n")).where("n > 1").select("d"), "repeated")
    bits = sized(found.count())
    out = filter_bits(found.select(slot_column("d", bits).alias("slot")), bits)
    discard(found)
    return out


def store(docs: DataFrame) -> DataFrame:
    """Write the chunk store: ``doc_id, copy, n_bytes, digests, own, digest, bytes, away``.

    A file's row (``digest`` null) has its whole chunk list and, compressed, the chunks that are its
    own; a chunk's row has one possibly shared chunk, once for each task that met it.
    """
    bits = docs.sparkSession.sparkContext.broadcast(shared_filter(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for part in sliced(batches):
            rows: list[tuple] = []
            for doc, copy, text in zip(part.column("doc_id").to_pylist(), part.column("copy").to_pylist(), binary_column(part, "text"), strict=True):
                own, names, away = [], [], []
                for digest, data in chunked(wav(payload_of(text))):
                    names.append(digest)
                    slot = _slot(digest, 8 * len(bits.value))
                    if bits.value[slot >> 3] >> (slot & 7) & 1:
                        away.append(len(names) - 1)
                        if digest not in met:
                            if len(met) > 200_000:
                                met.clear()
                            met.add(digest)
                            rows.append((None, None, None, None, None, digest, zlib.compress(data, 6), None))
                    else:
                        own.append(data)
                lens = struct.pack(f"<{len(own)}I", *map(len, own))
                rows.append((doc, copy, len(text), names, zlib.compress(struct.pack("<I", len(own)) + lens + b"".join(own), 6), None, None, away))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32())]
            names_ = ["doc_id", "copy", "n_bytes", "digests", "own", "digest", "bytes", "away"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names_)

    numbered = texts(docs).withColumn("copy", F.monotonically_increasing_id())
    schema = "doc_id long, copy long, n_bytes long, digests array<binary>, own binary, digest binary, bytes binary, away array<int>"
    return table(numbered.mapInArrow(tidy(run), schema), "chunks")


def _own_parts(own: bytes) -> list[bytes]:
    data = zlib.decompress(own)
    (n,) = struct.unpack_from("<I", data)
    out, at = [], 4 + 4 * n
    for size in struct.unpack_from(f"<{n}I", data, 4):
        out.append(data[at : at + size])
        at += size
    return out


def read_back(stored: DataFrame) -> DataFrame:
    """One row per file, computed from the stored bytes."""
    files = stored.where("digest is null").drop("digest", "bytes")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            columns = [batch.column(n).to_pylist() for n in ("n_bytes", "digests", "own", "away", "parts")]
            for n, names, own, away, parts in zip(*columns, strict=True):
                if away:
                    got = {p["at"]: zlib.decompress(p["bytes"]) for p in parts or ()}
                    mine = iter(_own_parts(own))
                    data = [got[i] if i in got else next(mine, b"") for i in range(len(names))]
                else:
                    data = _own_parts(own)
                rows.append(_read(n, _rebuilt(names, data), len(names)))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(_OUT_KINDS), _OUT_KINDS, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *_OUT_NAMES])

    part = "array<struct<at:int,bytes:binary>>"
    alone = files.where("size(away) = 0").withColumn("parts", F.lit(None).cast(part))
    # a table of its own: the join below then has nothing but its two sides, and Spark can split a chunk that very many files have
    chunks = table(stored.where("digest is not null").groupBy("digest").agg(F.first("bytes").alias("bytes")), "shared")
    wanted = files.where("size(away) > 0").select("copy", "digests", F.explode("away").alias("at")).select("copy", "at", F.expr("digests[at]").alias("digest"))
    fetched = wanted.join(chunks, "digest").groupBy("copy").agg(F.collect_list(F.struct("at", "bytes")).alias("parts"))
    mixed = files.where("size(away) > 0").join(fetched, "copy").select(*files.columns, "parts")
    return alone.select(*files.columns, "parts").unionByName(mixed).mapInArrow(tidy(whole), f"doc_id long, {_OUT}")


def media_features(docs: DataFrame) -> DataFrame:
    """Store every document's payload as media, read it back, and describe what was read.

    Null and empty texts are one block of padding. A chunk list rebuilds its file or the job fails:
    nothing is left out. Repeated rows each get a row; equal texts have equal values. Extra columns
    are ignored; an empty table gives no rows.
    """
    return read_back(store(docs))


def oracle_sql() -> str:
    """The query's rows as DuckDB SQL, the file's header and the checksum worked out there."""
    little = lambda x: " || ".join(f"printf('%02X', ((({x}) >> {8 * i}) & 255)::BIGINT)" for i in range(4))
    head = f"'52494646' || {little('36 + m')} || '57415645666D7420' || '10000000' || '01000100' || {little(RATE)} || {little(RATE)} || '01000800' || '64617461' || {little('m')}"
    bins = ", ".join(f"count(*) FILTER (WHERE b // 16 = {k})" for k in range(16))
    return rf"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t, row_number() OVER () AS r FROM documents),
z AS (SELECT r, doc_id, t, octet_length(t)::BIGINT AS n, greatest({BLOCK}, (octet_length(t) + {BLOCK - 1}) // {BLOCK} * {BLOCK})::BIGINT AS m FROM d),
p AS (SELECT r, doc_id, n, m, hex(t) || repeat('FF', m - n) AS p FROM z),
w AS (SELECT *, {head} || p AS w FROM p),
b AS (SELECT r, unnest(list_transform(regexp_extract_all(p, '..'), lambda x: ('0x' || x)::BIGINT)) AS b, unnest(range(1, m + 1)) AS i, m FROM p),
q AS (SELECT r, m, i, b, (b >= 128) <> (lag(b) OVER (PARTITION BY r ORDER BY i) >= 128) AS crossed FROM b),
f AS (SELECT r, sum(b)::DOUBLE AS s, any_value(m)::DOUBLE AS m, sqrt((sum(b * b) * any_value(m) - sum(b) * sum(b))::DOUBLE) / any_value(m) AS dev, count(*) FILTER (WHERE crossed) AS crossings,
  [{bins}] AS bins, list(b::UBIGINT ORDER BY i) FILTER (WHERE i > m - 32) AS tail FROM q GROUP BY r),
k AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS k),
c AS (SELECT r, xor(list_reduce(list_prepend(4294967295::UBIGINT, tail), lambda c, x: xor(c >> 8, k[(xor(c, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS crc FROM f, k)
SELECT w.doc_id, w.n AS n_bytes, w.m AS payload_bytes, sha256(unhex(p)) AS payload_sha256, crc AS tail_crc32, (44 + w.m)::BIGINT AS media_bytes, sha256(unhex(w)) AS media_sha256,
  printf('%.4f', s / f.m) || ';' || printf('%.4f', dev) || ';' || crossings || ';' || array_to_string(bins, ',') AS feature
FROM w JOIN f USING (r) JOIN c USING (r)
"""
