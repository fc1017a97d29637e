"""b-bit MinHash near-duplicate detection.

Each distinct shingle set keeps 192 minima: their low four bits, packed as bit planes into twelve
longs, and 38 band keys of five whole minima each. Band buckets give candidates, bit counts of the
planes estimate their similarity corrected for chance agreement of four-bit values, and whole
shingle sets confirm every link.

A pair at similarity 0.8 shares no band with probability (1 - 0.8^5)^38 = 3e-7, and its estimate,
whose standard deviation is 0.03, falls under the cut of 0.64 with about the same.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import binary_column, columns, components, discard, fresh, marks, mix, row_name, shingle_hashes, sliced, table, texts, tidy, word_hashes

HASHES, ROWS, LOW_BITS = 192, 5, 4
BANDS = HASHES // ROWS
WORDS = HASHES // 64
ESTIMATE_CUT = 0.64
#: Centres of a class that round one estimates.
CENTRES = 3
#: Shingles of one side of a block of texts, classes of one side of a block of a bucket.
BLOCK, BUCKET = 200_000, 512
#: Parts of a family where its rows must meet by its name.
SALTS = 32
_MULTIPLIERS = (mix(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z lower-cased (``bytes.lower`` touches only these)."""
    return np.unique(shingle_hashes(word_hashes(text.lower()), k))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The 192 minima; long sets go through in pieces of bounded size."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        np.minimum(out, (_MULTIPLIERS[:, None] * low[None, at : at + 4096]).min(axis=1), out=out)
    return out


def packed(mins: np.ndarray) -> np.ndarray:
    """Bit planes: plane p has bit p of each minimum, 64 minima to a long."""
    planes = [np.packbits((mins >> np.uint32(p)).astype(np.uint8) & 1, bitorder="little").view(np.int64) for p in range(LOW_BITS)]
    return np.concatenate(planes)


def band_keys(mins: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    rows = mins[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    for i in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return keys.view(np.int64)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, key, key2, n_shingles, digest, sig, bands``; the keys name the row's doc_id and text, digest names the set, sig
    and bands are null if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n, digests, sigs, bands = [], [], [], []
            for text in binary_column(batch, "text"):
                own = shingle_set(text, k)
                n.append(len(own))
                digests.append(xxhash.xxh128_digest(own.tobytes()))
                mins = minima(own)
                sigs.append(packed(mins) if len(own) else None)
                bands.append(band_keys(mins) if len(own) else None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "key", "key2")], pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, longs), pa.array(bands, longs)],
                ["doc_id", "key", "key2", "n_shingles", "digest", "sig", "bands"],
            )

    key, key2 = row_name()
    named = texts(docs).withColumns({"key": key, "key2": key2})
    return named.mapInArrow(tidy(run), "doc_id long, key long, key2 long, n_shingles long, digest binary, sig array<long>, bands array<long>")


def _texts_of(docs: DataFrame, names: DataFrame) -> DataFrame:
    """``class, digest, text`` of the rows that stand for the classes in ``names(class, key, digest)``, and of few others:
    a key only routes, and a text whose set has another digest is not the class's."""
    key, _ = row_name()
    held = marks(names.select(F.col("key").alias("doc_id"))).split(texts(docs), True, key)
    return held.select(key.alias("key"), "text").join(names, "key").select("class", "digest", "text")


def estimate(a: str, b: str):
    """Similarity of two packed signatures: agreement of four-bit values, less what chance gives."""
    differ = None
    for w in range(WORDS):
        x = None
        for p in range(LOW_BITS):
            i = p * WORDS + w
            one = F.col(a)[i].bitwiseXOR(F.col(b)[i])
            x = one if x is None else x.bitwiseOR(one)
        differ = F.bit_count(x) if differ is None else differ + F.bit_count(x)
    chance = 2.0**-LOW_BITS
    return ((HASHES - differ) / F.lit(float(HASHES)) - chance) / (1 - chance)


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of ``pairs(a, b)`` of ``classes(class, key, digest)`` those whose whole sets meet ``100 * shared >= percent * joined``.

    Only texts of rows that stand for a class in a pair, and the few others that a fixed-size filter lets
    through, are shuffled. A centre with very many partners makes a skewed join, which Spark splits;
    each task keeps the few sets it used last.
    """
    met = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
    wanted = _texts_of(docs, table(classes.join(met, "class").select("class", "key", "digest"), "names"))
    both = pairs.join(wanted.toDF("a", "da", "ta"), "a")
    both = both.join(wanted.toDF("b", "db", "tb"), "b").select("a", "b", "da", "db", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def of(digest: bytes, text: bytes) -> np.ndarray | None:
            if digest not in recent:
                own = shingle_set(text, k)
                if xxhash.xxh128_digest(own.tobytes()) != digest:
                    return None
                recent[digest] = own
                if len(recent) > 8:
                    recent.popitem(last=False)
            recent.move_to_end(digest)
            return recent[digest]

        for batch in sliced(batches):
            keep = []
            columns = [batch.column(c).to_pylist() for c in ("da", "db")]
            for i, j, x, y in zip(*columns, binary_column(batch, "ta"), binary_column(batch, "tb"), strict=True):
                p, q = of(j, y), of(i, x)
                shared = -1 if p is None or q is None else len(np.intersect1d(p, q, assume_unique=True))
                keep.append(shared >= 0 and 100 * shared >= percent * (len(p) + len(q) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return both.mapInArrow(tidy(run), "a long, b long")


_LEFT, _RIGHT = 0, 1


def _hits(held: dict[str, np.ndarray], percent: int) -> list[tuple[int, int, int, int, list[int]]]:
    """``(a, n, fam, j, bs)`` of one bucket: for each left class the right ones of other components that the estimate passes."""
    left, right = np.flatnonzero(held["side"] == _LEFT), np.flatnonzero(held["side"] == _RIGHT)
    out = []
    step = max(1, (1 << 18) // max(1, len(right)))
    size, comp, doc, main = held["n"], held["comp"], held["a"], held["in_main"]
    place = np.stack([held["fam"][right], held["j"][right]], axis=1)
    for at in range(0, len(left) if len(right) else 0, step):
        x = left[at : at + step]
        ok = (comp[x][:, None] != comp[right][None]) & (main[right][None] | (doc[x][:, None] > doc[right][None]))
        n, m = size[x][:, None], size[right][None]
        ok &= np.minimum(n, m) * 100 >= np.maximum(n, m) * percent
        i, k = np.nonzero(ok)
        planes = (held["sig"][x[i]] ^ held["sig"][right[k]]).reshape(-1, LOW_BITS, WORDS)
        differ = np.bitwise_count(np.bitwise_or.reduce(planes, axis=1).view(np.uint64)).sum(axis=1, dtype=np.int64)
        chance = 2.0**-LOW_BITS
        good = ((HASHES - differ) / HASHES - chance) / (1 - chance) >= ESTIMATE_CUT
        i, k = i[good], k[good]
        for one in np.unique(i).tolist():
            mine = k[i == one]
            places, which = np.unique(place[mine], axis=0, return_inverse=True)
            for w, (fam, j) in enumerate(places.tolist()):
                out.append((int(doc[x[one]]), int(size[x[one]]), fam, j, doc[right[mine[which.reshape(-1) == w]]].tolist()))
    return out


def candidates(placed: DataFrame, percent: int) -> DataFrame:
    """``a, n, fam, j, bs``: classes outside a bucket's commonest component, with those they may be linked to.

    Pairs are found inside a task and leave it as lists, a row for each class, bucket and block of
    partners. A bucket's sides are dealt to blocks of ``BUCKET`` classes, so none is large.
    """
    slot = lambda n: F.pmod(F.xxhash64("a"), F.col(n))
    names = ["key", "lb", "rb", "side", "a", "n", "sig", "comp", "in_main", "fam", "j"]
    left = placed.where("not in_main").withColumns({"side": F.lit(_LEFT), "lb": slot("lefts"), "rb": F.explode(F.sequence(F.lit(0), F.col("rights") - 1))})
    right = placed.withColumns({"side": F.lit(_RIGHT), "rb": slot("rights"), "lb": F.explode(F.sequence(F.lit(0), F.col("lefts") - 1))})
    dealt = left.select(names).unionByName(right.select(names)).repartition("key", "lb", "rb").sortWithinPartitions("key", "lb", "rb", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None
        rows: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], ["a", "n", "fam", "j", "bs"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names if c != "sig"}
            now["sig"] = batch.column("sig").flatten().to_numpy(zero_copy_only=False).reshape(-1, WORDS * LOW_BITS)
            if rest is not None:
                now = {c: np.concatenate([rest[c], now[c]]) for c in names}
            change = (np.diff(now["key"]) != 0) | (np.diff(now["lb"]) != 0) | (np.diff(now["rb"]) != 0)
            ends = np.flatnonzero(change) + 1
            for begin, end in zip([0, *ends], ends):  # noqa: B905
                rows += _hits({c: v[begin:end] for c, v in now.items()}, percent)
            rest = {c: v[ends[-1] :] if len(ends) else v for c, v in now.items()}
            if len(rows) > 20_000:
                yield batch_of(rows)
                rows = []
        if rest is not None:
            rows += _hits(rest, percent)
        yield batch_of(rows)

    return dealt.mapInArrow(tidy(run), "a long, n long, fam long, j long, bs array<long>")


def confirmed_in_blocks(found: DataFrame, members: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Confirm ``found(a, n, fam, j, bs)`` of ``classes`` on whole sets; ``members(b, fam, j)`` says which block each partner is in.

    A text goes once to each block that needs it, instead of once to each pair. A block has about
    ``BLOCK`` shingles on either side.
    """
    spread = found.groupBy("fam", "a").agg(F.max("n").alias("n")).groupBy("fam").agg(F.ceil(F.sum("n") / BLOCK).cast("long").alias("parts"))
    spread = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("a", "j"), F.lit(SALTS)).cast("int"))
    dealt = salted.join(spread.hint("merge"), ["fam", "salt"]).withColumn("i", F.pmod(F.xxhash64("a"), F.greatest("parts", F.lit(1))))
    key = ["fam", "i", "j"]
    dealt = table(dealt.groupBy(*key, "a").agg(F.array_distinct(F.flatten(F.collect_list("bs"))).alias("bs")), "dealt")
    needed = table(dealt.select(*key).distinct().join(members, ["fam", "j"]).select(*[F.col(c).alias(f"{c}_") for c in key], "b"), "needed")
    met = dealt.select(F.col("a").alias("class")).union(needed.select(F.col("b").alias("class"))).distinct()
    wanted = _texts_of(docs, table(classes.join(met, "class").select("class", "key", "digest"), "names"))
    no_list = F.lit(None).cast("array<long>")
    left = dealt.join(wanted.withColumnRenamed("class", "a"), "a").select(*key, F.lit(_LEFT).alias("side"), F.col("a").alias("doc"), "bs", "digest", "text")
    right = needed.join(wanted.withColumnRenamed("class", "b"), "b").select(*[F.col(f"{c}_").alias(c) for c in key], F.lit(_RIGHT).alias("side"), F.col("b").alias("doc"), no_list.alias("bs"), "digest", "text")
    blocks = left.unionByName(right).repartition(*key).sortWithinPartitions(*key, F.desc("side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's right sets come first and are held; each left one is then met with those it asks for."""
        block, sets = None, {}
        for batch in sliced(batches):
            out_a, out_b = [], []
            columns = [batch.column(c).to_pylist() for c in (*key, "side", "doc", "bs", "digest")]
            for fam, i, j, side, doc, bs, digest, text in zip(*columns, binary_column(batch, "text"), strict=True):
                if block != (fam, i, j):
                    block, sets = (fam, i, j), {}
                own = shingle_set(text, k)
                if xxhash.xxh128_digest(own.tobytes()) != digest:
                    continue
                if side == _RIGHT:
                    sets[doc] = own
                    continue
                held = [sets[b] for b in bs]
                lengths = np.array([len(x) for x in held])
                every = np.concatenate(held)
                same = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
                shared = np.add.reduceat(same.astype(np.int64), np.cumsum(lengths) - lengths)
                linked = np.asarray(bs)[100 * shared >= percent * (len(own) + lengths - shared)].tolist()
                out_a += [doc] * len(linked)
                out_b += linked
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return blocks.mapInArrow(tidy(run), "a long, b long")


def _classified(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``doc_id, key, key2, n_shingles, component_id, kept``, a row for each document."""
    sets = table(signatures(docs, k), "sets")
    # a class is a set of shingles; its number is given once, and no doc_id stands for it before the end
    filled = sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest")
    one = filled.agg(F.min("doc_id").alias("rep"), F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("n_shingles", "sig", "bands")])
    # numbers follow the smallest doc_ids, so a bucket's first class is the oldest one, of which the others are likelier to be copies than of each other
    found = table(one, "found")
    classes = table(found.orderBy("rep", "digest").withColumn("class", F.monotonically_increasing_id()), "classes")
    discard(found)
    reps = classes.select(F.col("class").alias("a"), F.col("n_shingles").alias("n"), "sig", "bands")

    bands = reps.select("a", F.explode("bands").alias("key"))
    buckets = bands.groupBy("key").agg(F.min("a").alias("b"), F.count("*").alias("c")).where("c > 1").select("key", "b")
    members = table(bands.join(buckets, "key"), "members")
    sigs = reps.select("a", "n", "sig")
    # a class has one bucket in each band, so the lists are short whatever the data
    tried = members.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("c")).groupBy("a").agg(F.sort_array(F.collect_list(F.struct("c", (-F.col("b")).alias("b"))), asc=False).alias("m"))
    stars = tried.select("a", F.explode(F.slice("m", 1, CENTRES)).alias("m")).select("a", (-F.col("m.b")).alias("b"))
    scored = stars.join(sigs, "a").join(sigs.select(F.col("a").alias("b"), F.col("n").alias("n2"), F.col("sig").alias("sig2")), "b")
    alike = scored.where((F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent) & (estimate("sig", "sig2") >= ESTIMATE_CUT))
    best = alike.select("a", "b", estimate("sig", "sig2").alias("e")).groupBy("a").agg(F.max(F.struct("e", (-F.col("b")).alias("b"))).alias("m"))
    pairs = table(best.select("a", (-F.col("m.b")).alias("b")), "pairs")
    first = table(confirmed(pairs, classes, docs, k, percent), "links")
    discard(pairs)
    comps = components(first, "first")

    placed = members.select("key", "a").join(comps, members.a == comps.id, "left").select("key", "a", F.coalesce("comp", "a").alias("comp"))
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("all"), F.count("*").alias("kinds")).where("kinds > 1")
    blocks = lambda n: F.ceil(n / BUCKET).cast("int")
    mixed = mixed.select("key", F.col("m.comp").alias("main"), blocks(F.col("all") - F.col("m.c")).alias("lefts"), blocks(F.col("all")).alias("rights"))
    placed = table(placed.join(mixed, "key").join(sigs, "a"), "placed")
    discard(members, comps)
    family = placed.groupBy("a").agg(F.min("main").alias("fam"), F.max("n").alias("n"))
    parts = family.groupBy("fam").agg(F.greatest(F.ceil(F.sum("n") / BLOCK).cast("long"), F.lit(1)).alias("parts"))
    where = table(family.join(parts, "fam").select("a", "fam", F.pmod(F.xxhash64("a"), "parts").alias("j")), "families")
    found = table(candidates(placed.join(where, "a").withColumn("in_main", F.col("comp") == F.col("main")), percent), "found")
    discard(placed)
    second = table(confirmed_in_blocks(found, where.withColumnRenamed("a", "b"), classes, docs, k, percent), "links")
    discard(found, where)
    comps = components(first.union(second), "second")
    discard(first, second)

    placed = table(classes.select("class", "digest", "rep").join(comps, F.col("class") == comps.id, "left").select("digest", "rep", F.coalesce("comp", "class").alias("comp")), "placed")
    least = table(placed.groupBy("comp").agg(F.min("rep").alias("component_id")), "least")
    named = table(placed.join(least, "comp").select("digest", "component_id"), "named")
    discard(comps, placed, least, classes)
    out = sets.select("doc_id", "key", "key2", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "key", "key2", "n_shingles", component.cast("long").alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents with equal shingle sets form a class, which has a number of its own, and only classes
    are compared. Round one takes the smallest members of a class's buckets, those it meets in most
    bands, and confirms the best-estimated; round two confirms every pair that shares a bucket, passes the estimate and is not
    linked by then. No pair is left out by a cap: within a component pairs need no comparing, and
    in round two a bucket's commonest component is met only by those outside it.

    Null, empty and blank texts have no shingles and stand alone. Texts shorter than k words are one
    shingle. Every row gives a row: repeated rows alike, and rows of one doc_id with different texts each by
    its own text. Rows without a doc_id have no component, link nothing and are kept. Very long texts go through
    in stretches. Extra columns are ignored; an empty table gives no rows.
    """
    return _classified(docs, k, percent).drop("key", "key2")


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` less all rows but those of the smallest doc_id of every component, with all columns.

    Shingles are of five words here, as in any stage without a contract of its own. Rows that
    ``near_duplicates`` keeps stay as they are, so nulls, empty texts, rows without a doc_id and repeated
    rows of a kept doc_id all stay; of a doc_id with several texts each row goes or stays by its own. Extra
    columns stay whatever their names; an empty table stays empty.

    Rows that a filter of the dropped ones does not name stay where they are; the others are shuffled and
    held against the dropped rows' names of 128 bits.
    """
    dropped = table(_classified(docs, k, percent).where("not kept").select("key", "key2").distinct(), "dropped")
    key, key2 = row_name()
    named = marks(dropped.select(F.col("key").alias("doc_id")))
    one, two = fresh(docs, 2)
    maybe = named.split(docs, True, key).withColumns({one: key, two: key2})
    rest = maybe.join(dropped.toDF(one, two), [one, two], "left_anti").select(*columns(docs))
    return named.split(docs, False, key).unionByName(rest)


def oracle_sql(k: int, percent: int) -> str:
    """The query's rows as DuckDB SQL over all pairs that share a shingle: for small tables only."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= {k} THEN list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS n, b.n AS m, count(*) AS shared FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p WHERE 100 * shared >= {percent} * (n + m - shared)),
r(id, reach) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.id, l.y FROM r JOIN l ON r.reach = l.x),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON c.id = doc_id
"""
