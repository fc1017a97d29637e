"""What several corpus operators share: lineage cuts, word hashing, label propagation."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes hashed at a time, so that a giant text never becomes one list of words.
SEGMENT = 1 << 22


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. Where the session names none, a local master gets a local folder, and a cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        where = tempfile.mkdtemp(prefix="meridian-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/meridian/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete what ``table`` wrote, once nothing that is still to run reads it."""
    for df in tables:
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application left in the shared folder. Results not yet written are lost with them."""
    _delete(spark, f"{shared_dir(spark)}/meridian/{spark.sparkContext.applicationId}")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and after a task's last batch what its worker no longer needs goes back to the system: idle
    workers of other stages stay alive beside the busy ones."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return whole


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and whole ``text`` (null becomes empty), nothing else reaches the scan."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows; of the whole sequence where it is shorter; none without words."""
    if not len(words):
        return words
    width = min(k, len(words))
    out = np.full(len(words) - width + 1, np.uint64(width))
    for i in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(out)])
    return out


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that a task holds little at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes, without decoding it."""
    column = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(id, comp)``, comp being the smallest id reachable.

    Each round takes the smallest label among neighbours, then follows that label's own label, so
    a path of n links takes about log n rounds. State stays in tables; only a count of the labels
    that moved comes to the driver.
    """
    both = table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-links")
    labels = table(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), name)
    while True:
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        stepped = labels.join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "near").alias("to"))
        own = labels.select(F.col("id").alias("to"), F.col("comp").alias("further"))
        after = stepped.join(own, "to").select("id", F.least("to", "further").alias("comp"), (F.least("to", "further") != F.col("was")).alias("moved"))
        after = table(after, name)
        discard(labels)
        labels = after.select("id", "comp")
        if after.where("moved").isEmpty():
            discard(both)
            return labels


_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: By number of bytes, what of eight bytes belongs to a word.
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def words_in(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes."""
    edge = np.diff((~_SPACE[np.frombuffer(data, np.uint8)]).astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class WordTable:
    """What a worker worked out for the words it met, ids and a value for each: a direct-mapped table of fixed size.

    A word of up to 15 bytes is its own key, as two numbers with its length on top; a longer one is a key
    of a dictionary of bounded size, and its number there is its key here. So no two words can be taken
    for each other, and most are found without a look at them one by one.
    """

    def __init__(self, slots: int = 1 << 20, held: int = 4_000_000, long_bytes: int = 8 << 20) -> None:
        self.slots, self.held, self.long_bytes = slots, held, long_bytes
        self.low, self.high = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.places, self.sizes = np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.values = np.zeros(slots)
        self.flat = np.zeros(held, np.uint32)
        self.used = 0
        self.long: dict[bytes, int] = {}
        self.long_size = 0

    def _keys(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        eight = np.ndarray((len(data) + 9,), "<u8", data + bytes(16), 0, (1,))
        sizes = ends - starts
        low = eight[starts] & _KEPT[np.minimum(sizes, 8)]
        high = eight[np.minimum(starts + 8, len(data) + 8)] & _KEPT[np.clip(sizes - 8, 0, 7)] | sizes.astype(np.uint64) << np.uint64(56)
        far = np.flatnonzero(sizes > 15)
        if self.long_size > self.long_bytes:  # their numbers start anew, so nothing that has one may stay
            self.long, self.long_size = {}, 0
            self.high[self.high >> np.uint64(56) == 255] = 0
        for i, a, b in zip(far.tolist(), starts[far].tolist(), ends[far].tolist(), strict=True):
            word = data[a:b]
            if word not in self.long:
                self.long[word] = len(self.long)
                self.long_size += len(word) + 100
            low[i] = self.long[word]
        high[far] = np.uint64(255) << np.uint64(56)
        return low, high

    def look_up(self, data: bytes, starts: np.ndarray, ends: np.ndarray, make: Callable[[list[bytes]], list[tuple[Sequence[int], float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words in a row, how many each has, and each one's value. ``make`` is asked for unknown words, once each."""

        def rows(new: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            found = make(new)
            lengths = np.fromiter((len(ids) for ids, _ in found), np.int64, len(found))
            worth = np.fromiter((v for _, v in found), np.float64, len(found))
            return np.fromiter(chain.from_iterable(ids for ids, _ in found), np.uint32, int(lengths.sum())), lengths, worth

        return self.look_up_rows(data, starts, ends, rows)

    def look_up_rows(self, data: bytes, starts: np.ndarray, ends: np.ndarray, make: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``look_up`` with a ``make`` that gives what this gives: ids in a row, how many each word has, and values."""
        low, high = self._keys(data, starts, ends)
        slots = (mix(low + high * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(self.slots - 1)).astype(np.int64)
        places, sizes, values = self.places[slots].astype(np.int64), self.sizes[slots].astype(np.int64), self.values[slots]
        missed = np.flatnonzero((self.low[slots] != low) | (self.high[slots] != high))
        if len(missed):
            new: dict[bytes, int] = {}
            which = np.array([new.setdefault(data[a:b], len(new)) for a, b in zip(starts[missed].tolist(), ends[missed].tolist(), strict=True)], np.int64)
            made, lengths, worth = make(list(new))
            more = len(made)
            if self.used + more > self.held:  # start over, keeping what this call looks up
                sizes[missed] = 0
                keep = np.repeat(places - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                self.high[:], self.used = 0, len(keep)
                self.flat = np.concatenate([self.flat[keep], np.zeros(max(self.held, more), np.uint32)])
                places = np.cumsum(sizes) - sizes
            begin = self.used + np.cumsum(lengths) - lengths
            self.flat[self.used : self.used + more] = made
            self.used += more
            places[missed], sizes[missed], values[missed] = begin[which], lengths[which], worth[which]
            at = slots[missed]  # where several share a slot, the last one of a kind has all of it
            order = np.full(self.slots, -1, np.int64) if len(missed) > self.slots // 8 else None
            if order is not None:
                order[at] = missed
                missed = order[order >= 0]
            else:
                missed = np.array(list(dict(zip(at.tolist(), missed.tolist(), strict=True)).values()), np.int64)
            at = slots[missed]
            self.low[at], self.high[at], self.places[at], self.sizes[at], self.values[at] = low[missed], high[missed], places[missed], sizes[missed], values[missed]
        after = np.cumsum(sizes)
        return self.flat[np.repeat(places - (after - sizes), sizes) + np.arange(after[-1] if len(after) else 0)], sizes, values


def segments(data: bytes, size: int = SEGMENT) -> Iterator[bytes]:
    """Stretches of a text of about ``size`` bytes, cut at white space, so that no word is cut."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield data[at:end]
        at = end


def word_segments(data: bytes) -> Iterator[list[bytes]]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, a bounded stretch of it at a time; ``bytes.split`` splits at the same bytes."""
    return (part.split() for part in segments(data))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text in order, each of the word's own bytes."""
    parts = [np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) for words in word_segments(data)]
    return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.uint64), *parts])


# filters: which rows a set of keys may name, told on the tasks that hold the rows

#: Bits for each key, and the most 64-bit words of a filter: as rows of a broadcast table some 40 MB.
KEY_BITS, MOST_WORDS = 16, 1 << 19
#: Ids, at most, that are broadcast themselves: as many rows as the largest filter has.
MOST_IDS = 1 << 19
#: Bits of the largest map that Python workers get.
MOST_BITS = 1 << 26


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever is in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fresh(df: DataFrame, n: int) -> list[str]:
    """Names that no column of ``df`` has, in whatever case."""
    taken, out, i = {c.lower() for c in df.columns}, [], 0
    while len(out) < n:
        if f"__{i}" not in taken:
            out.append(f"__{i}")
        i += 1
    return out


def row_name() -> tuple[Column, Column]:
    """Two numbers of 64 bits for what ``doc_id`` and ``text`` hold; rows that have the same of both share them."""
    held = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    return F.xxhash64(*held), F.xxhash64(F.lit(1), *held)


def row_key() -> Column:
    """A 128-bit name for what ``doc_id`` and ``text`` hold; rows that have the same of both share it."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))


def sized(keys: int) -> int:
    """Bits of a map for so many keys."""
    return min(MOST_BITS, max(1 << 16, 1 << (KEY_BITS * keys - 1).bit_length())) if keys else 1 << 16


def filter_bits(slots: DataFrame, bits: int) -> np.ndarray:
    """The bits named by ``slot`` (0 to ``bits`` - 1) as bytes, built by Spark in maps of 4 KB."""
    number = F.col("slot") + 1
    maps = slots.select(F.bitmap_bucket_number(number).alias("b"), F.bitmap_bit_position(number).alias("p"))
    out = np.zeros(bits // 8, np.uint8)
    for row in maps.groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).toLocalIterator():
        at = (row["b"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(row["m"], np.uint8)[: len(out) - at]
    return out


def _bits_of(h: Column) -> Column:
    """Three of 64 bits, told by a hash."""
    one = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(63).cast("int")) for at in (40, 46, 52)]
    return one[0].bitwiseOR(one[1]).bitwiseOR(one[2])


@dataclass(frozen=True)
class Marks:
    """A Bloom filter of doc_ids as a table of 64-bit words, each key in one of them; joined as a broadcast, so rows are
    told apart in generated code. ``rows`` is None where the keys are too many for it: then all rows pass."""

    rows: DataFrame | None
    words: int
    seed: int

    def split(self, docs: DataFrame, named: bool, key: Column | None = None) -> DataFrame:
        """Rows whose doc_id, or ``key``, may be a key, or those whose is none. Rows without one are never keys."""
        key = F.col("doc_id").cast("long") if key is None else key
        if self.rows is None:
            return docs.where(key.isNotNull() if named else key.isNull())
        key_, at, word, bits = fresh(docs, 4)
        h = F.xxhash64(F.col(key_), F.lit(self.seed))
        mask = _bits_of(h)
        hit = F.coalesce(F.col(key_).isNotNull() & (F.col(bits).bitwiseAND(mask) == mask), F.lit(False))
        placed = docs.withColumn(key_, key).withColumn(at, F.pmod(h, F.lit(self.words)))
        joined = placed.join(F.broadcast(self.rows.toDF(word, bits)), F.col(at) == F.col(word), "left")
        return joined.where(hit if named else ~hit).select(*columns(docs))


def marks(ids: DataFrame, seed: int = 0) -> Marks:
    """A filter of ``ids(doc_id)``, sized by their number: about one of 150 other ids passes it."""
    n = ids.count()
    if n * KEY_BITS > MOST_WORDS * 256:
        return Marks(None, 0, seed)
    words = min(MOST_WORDS, max(1024, 1 << (max(1, n * KEY_BITS // 64) - 1).bit_length()))
    h = F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed))
    named = ids.where("doc_id is not null").select(F.pmod(h, F.lit(words)).alias("__word"), _bits_of(h).alias("__bits"))
    return Marks(table(named.groupBy("__word").agg(F.bit_or("__bits").alias("__bits")), "marks"), words, seed)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, text`` of all documents named in ``ids(doc_id)``, and of few others: spares the rest a shuffle."""
    return marks(ids).split(texts(docs), True)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` less the rows whose doc_id is in ``ids(doc_id)``.

    A filter passes most rows on where they are; only those that it takes for named are shuffled and
    held against the ids themselves. Rows without a doc_id stay.
    """
    named = marks(ids)
    return named.split(docs, False).unionByName(named.split(docs, True).join(ids, "doc_id", "left_anti").select(*columns(docs)))


def texts_in(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, text`` of exactly the documents named in the distinct ``ids(doc_id)``, with hardly a text shuffled.

    Up to ``MOST_IDS`` ids are broadcast, and nothing is written. Of more, a first filter lets through all
    that are named and some others. Those others' ids, found by a join of ids alone, make a second filter
    under another hash. What passes the first and not the second is named for certain; what passes both,
    named or not, is joined with the ids. Ids too many for a filter are joined with the texts.
    """
    ids = ids.where("doc_id is not null").select("doc_id")
    if ids.count() <= MOST_IDS:
        return texts(docs).join(F.broadcast(ids), "doc_id", "left_semi")
    ids = table(ids, "named")
    first = marks(ids)
    if first.rows is None:
        return texts(docs).join(ids, "doc_id", "left_semi")
    wrong = table(first.split(docs.select(F.col("doc_id").cast("long")), True).join(ids, "doc_id", "left_anti").distinct(), "wrong")
    others, passed = marks(wrong, 1), first.split(texts(docs), True)
    return others.split(passed, False).unionByName(others.split(passed, True).join(ids, "doc_id", "left_semi"))
