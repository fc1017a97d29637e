"""Column-weighted BM25 keyword search.

Three forms give the same results: a tokenised column for each searched one, which a search reads whole;
postings, of which a search reads the buckets of its own words; and postings in slots with what each
slot of a token can score at best, of which a search reads the promising ones until no other can matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from meridian.functions.scores import bm25_term, idf
from meridian.functions.text import phrase_text, phrases_of, spaced_tokens, token_count

#: How much a hit in each column counts.
WEIGHTS = {"name": 5.0, "abstract": 2.0, "tags": 1.0, "item_identifier": 1.0, "description": 1.0}
CANDIDATES = 50
#: Tokens of text that a bucket of postings and a file of it hold, and the most buckets there are: their number is a file layout, not a limit.
BUCKET_TOKENS, FILE_TOKENS, MOST_BUCKETS = 8_000_000, 2_000_000, 1 << 14
#: Rows of one length that share a slot, and postings that a task gives out at a time.
SLOT_ROWS, GIVEN = 2048, 50_000


def _text(items: DataFrame, weights: Mapping[str, float]) -> dict[str, Column]:
    kinds = dict(items.dtypes)
    return {c: F.concat_ws(" ", c) if kinds[c].startswith("array") else F.col(c).cast("string") for c in weights}


def index(items: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """``items`` with a tokenised column ``t_<name>`` for each searched column, and ``n_tokens``.

    Write it once, partitioned by the filter columns; a search then reads only its own columns.
    Array columns are joined by spaces.
    """
    text = _text(items, weights)
    tokens = items.select("*", *[spaced_tokens(text[c]).alias(f"t_{c}") for c in weights])
    return tokens.withColumn("n_tokens", sum((token_count(F.col(f"t_{c}")) for c in weights), F.lit(0).cast("long")))


def occurrences(spaced: Column, tokens: list[str]) -> Column:
    """How often the tokens stand together in this order."""
    text = phrase_text(tokens)
    if any(tokens[:i] == tokens[-i:] for i in range(1, len(tokens))):  # may overlap itself
        words = F.split(F.trim(spaced), " +")
        want = F.array(*[F.lit(t) for t in tokens])
        at = F.sequence(F.lit(1), F.greatest(F.size(words) - len(tokens) + 1, F.lit(1)))
        return F.size(F.filter(at, lambda i: F.slice(words, i, len(tokens)) == want))
    hits = (F.length(spaced) - F.length(F.replace(spaced, F.lit(text), F.lit("")))) / len(text)
    return F.when(F.contains(spaced, F.lit(text)), hits.cast("int")).otherwise(0)


def search(indexed: DataFrame, query: str, *, key: str = "id", filters: Column | None = None, weights: Mapping[str, float] = WEIGHTS, limit: int | None = CANDIDATES) -> DataFrame:
    """``key, relevance`` of the best rows that have every word of the query; larger is better.

    A word of several tokens is a phrase inside one column; words may hit different columns. Counts
    of rows and mean length are those of the whole index, filters or not. They come from one
    aggregation over the tokenised columns, read as a scalar subquery.
    """
    phrases = phrases_of(query)
    spread = indexed.select(key, F.lit(0.0).alias("relevance"))
    if not phrases:
        return spread.filter(F.lit(False))
    has = [reduce(Column.__or__, [F.contains(f"t_{c}", F.lit(phrase_text(p))) for c in weights]) for p in phrases]
    counts = [F.count(F.when(h, 1)).alias(f"c{i}") for i, h in enumerate(has)]
    stats = indexed.agg(F.count("*").alias("n"), F.avg("n_tokens").alias("mean"), *counts).select(F.struct("*").alias("s")).scalar()
    rows = indexed.filter(reduce(Column.__and__, has))
    if filters is not None:
        rows = rows.filter(filters)
    rows = rows.withColumn("s", stats)
    score = F.lit(0.0)
    for i, p in enumerate(phrases):
        tf = sum((F.lit(float(w)) * occurrences(F.col(f"t_{c}"), p) for c, w in weights.items()), F.lit(0.0))
        score = score + bm25_term(idf(F.col("s.n").cast("double"), F.col(f"s.c{i}").cast("double")), tf, F.col("n_tokens").cast("double"), F.col("s.mean"))
    found = rows.select(key, score.alias("relevance"))
    return found if limit is None else found.orderBy(F.desc("relevance"), key).limit(limit)


def buckets_for(tokens: int) -> int:
    """Buckets of so many tokens of text, a power of two."""
    return min(MOST_BUCKETS, 1 << max(0, math.ceil(tokens / BUCKET_TOKENS) - 1).bit_length())


def bucket_of(token: Column, buckets: int) -> Column:
    """A bucket's number says of how many it is one, so batches of different sizes can lie side by side."""
    return (F.lit(buckets << 16) + F.pmod(F.xxhash64(token), F.lit(buckets))).cast("int")


def in_bucket(token: str) -> Column:
    """Whether the partition column ``bucket`` is that of a token: told from the folders' names alone."""
    buckets = F.shiftright("bucket", 16)
    return F.col("bucket") == F.shiftleft(buckets, 16) + F.pmod(F.xxhash64(F.lit(token)), buckets)


def slot_of(key: Column, n_tokens: Column, rows: int) -> Column:
    """Rows of like length in slots of about ``SLOT_ROWS``: short rows, of which a hit weighs more, are apart from long ones."""
    parts = max(1, math.ceil(rows / SLOT_ROWS))
    return F.floor(F.log2(n_tokens + F.lit(1)) * 2).cast("long") * F.lit(1 << 32) + F.pmod(F.xxhash64(key), F.lit(parts))


#: What ``write_postings`` writes beside the postings.
BLOCKS, LENGTHS = "token string, slot long, rows long, tf double, least long, bucket int", "rows long, tokens long"


def postings(items: DataFrame, *, key: str = "id", weights: Mapping[str, float] = WEIGHTS, filters: Sequence[str] = ()) -> DataFrame:
    """``token, key, field, positions, n_tokens, tf, first`` and the ``filters`` columns: where each token stands in each
    searched column of each row. Keys are distinct.

    ``n_tokens`` is the row's length over all columns, ``tf`` the weighted count of the token in the row, and
    ``first`` marks one of the fields that a row has a token in. A row's map from tokens to places is made in the
    row's own task, so a posting is made once and nothing is shuffled.
    """
    text = _text(items, weights)
    fields = list(weights)
    held = items.select(key, *filters, *[spaced_tokens(text[c]).alias(f"__{i}") for i, c in enumerate(fields)])
    names = [key, *filters]
    schema = pa.schema([(c, to_arrow_type(items.schema[c].dataType)) for c in names] + [("token", pa.string()), ("field", pa.string()), ("positions", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("tf", pa.float64()), ("first", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.select(names)
            rows: list[tuple] = []

            def given(rows: list[tuple], own: pa.RecordBatch = own) -> pa.RecordBatch:
                at, *columns = zip(*rows, strict=True)
                taken = own.take(pa.array(at, pa.int64()))
                return pa.RecordBatch.from_arrays([*[c.cast(t) for c, t in zip(taken.columns, schema.types, strict=False)], *[pa.array(c, t) for c, t in zip(columns, schema.types[len(names) :], strict=True)]], schema=schema)

            for i, texts in enumerate(zip(*[batch.column(f"__{j}").to_pylist() for j in range(len(fields))], strict=True)):
                places: dict[str, dict[str, list[int]]] = {}
                total = 0
                for field, value in zip(fields, texts, strict=True):
                    words = [w for w in value.split(" ") if w]
                    total += len(words)
                    for at, word in enumerate(words):
                        places.setdefault(word, {}).setdefault(field, []).append(at)
                for word, by_field in places.items():
                    tf = float(sum(weights[f] * len(at) for f, at in by_field.items()))
                    rows += [(i, word, f, at, total, tf, n == 0) for n, (f, at) in enumerate(by_field.items())]
                if len(rows) > GIVEN:
                    yield given(rows)
                    rows = []
            if rows:
                yield given(rows)

    kinds = dict(items.dtypes)
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", token string, field string, positions array<int>, n_tokens long, tf double, first boolean"
    return held.mapInArrow(run, ddl).select("token", key, "field", "positions", "n_tokens", "tf", "first", *filters)


def lengths(items: DataFrame, *, key: str = "id", weights: Mapping[str, float] = WEIGHTS, by: Sequence[str] = ()) -> DataFrame:
    """``rows, tokens`` of all items, or of those with each value of ``by``: what the mean length is made of.
    Rows without a word count as rows."""
    text = _text(items, weights)
    total = sum((token_count(spaced_tokens(text[c])) for c in weights), F.lit(0).cast("long"))
    return items.select(*by, total.alias("n")).groupBy(*by).agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"))


def dealt(found: DataFrame, rows: int, tokens: int, key: str = "id") -> DataFrame:
    """Postings of so many rows and tokens with their ``bucket`` and ``slot``, in one shuffle to as many tasks as their size asks
    for: by bucket and, as a common token's bucket may hold a large part of them, by row as well. Tokens and slots
    stand in order, so that a search reads the pages of its words."""
    buckets = buckets_for(tokens)
    files = max(1, math.ceil(tokens / FILE_TOKENS))
    placed = found.withColumns({"bucket": bucket_of(F.col("token"), buckets), "slot": slot_of(F.col(key), F.col("n_tokens"), rows)})
    return placed.repartition(files, F.col("bucket"), F.pmod(F.xxhash64(key), F.lit(math.ceil(files / buckets)))).sortWithinPartitions("bucket", "token", "slot")


def blocks(placed: DataFrame) -> DataFrame:
    """``bucket, token, slot, rows, tf, least``: of each slot of a token, how many rows have it, its largest weighted count and its
    shortest row. What a token scores in a slot is at most what these two give; a token's rows add up to its
    document frequency."""
    return placed.groupBy("bucket", "token", "slot").agg(F.count(F.when(F.col("first"), 1)).alias("rows"), F.max("tf").alias("tf"), F.min("n_tokens").alias("least"))


def write_postings(found: DataFrame, path: str, sizes: DataFrame, key: str = "id") -> None:
    """``path/postings`` and ``path/blocks``, a folder for each bucket, and ``path/lengths``, all from ``lengths`` and ``postings``."""
    spark = found.sparkSession
    sizes.write.mode("overwrite").parquet(f"{path}/lengths")
    total = spark.read.parquet(f"{path}/lengths").agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    placed = dealt(found, *total, key)
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    held = blocks(spark.read.schema(placed.schema).parquet(f"{path}/postings"))
    held.repartition("bucket").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")


def _of_tokens(held: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """The rows of these tokens: both filters reach the scan."""
    return held.filter(reduce(Column.__or__, [in_bucket(t) for t in tokens]) & F.col("token").isin(list(tokens)))


def _standing(held: Column, tokens: list[str]) -> Column:
    """How often the tokens stand together, by the map of their positions in one column."""
    first = F.coalesce(held[tokens[0]], F.array().cast("array<int>"))
    rest = [F.coalesce(held[t], F.array().cast("array<int>")) for t in tokens[1:]]
    return F.size(F.filter(first, lambda p: reduce(Column.__and__, [F.array_contains(r, p + i) for i, r in enumerate(rest, 1)], F.lit(True))))


def search_postings(held: DataFrame, stats: DataFrame, query: str, *, key: str = "id", filters: Column | None = None, weights: Mapping[str, float] = WEIGHTS, limit: int | None = CANDIDATES) -> DataFrame:
    """The rows of ``search``, from ``postings`` and ``stats(rows, tokens)``.

    Only buckets and tokens of the query are read: both filters reach the scan. A row brings one small
    map for each column, at most as many entries as the query has tokens. ``filters`` names columns of
    the postings and leaves the counts of rows as they are.
    """
    phrases = phrases_of(query)
    tokens = sorted({t for p in phrases for t in p})
    if not tokens:
        return held.select(key, F.lit(0.0).alias("relevance")).filter(F.lit(False))
    own = _of_tokens(held, tokens)
    passes = F.lit(True) if filters is None else F.coalesce(filters, F.lit(False))
    maps = own.groupBy(key, "field", "n_tokens", passes.alias("passes")).agg(F.map_from_entries(F.collect_list(F.struct("token", "positions"))).alias("at"))
    weight = reduce(lambda c, x: c.when(F.col("field") == x[0], F.lit(float(x[1]))), weights.items(), F.when(F.lit(False), F.lit(0.0))).otherwise(F.lit(0.0))
    counted = maps.select(key, "n_tokens", "passes", weight.alias("w"), *[_standing(F.col("at"), p).alias(f"f{i}") for i, p in enumerate(phrases)])
    rows = counted.groupBy(key, "n_tokens", "passes").agg(*[F.sum(F.col("w") * F.col(f"f{i}")).alias(f"tf{i}") for i in range(len(phrases))], *[F.sum(f"f{i}").alias(f"n{i}") for i in range(len(phrases))])
    total = stats.agg(F.sum("rows").alias("n"), (F.sum("tokens") / F.sum("rows")).alias("mean")).select(F.struct("*").alias("s")).scalar()
    counts = rows.agg(*[F.count(F.when(F.col(f"n{i}") > 0, 1)).alias(f"c{i}") for i in range(len(phrases))]).select(F.struct("*").alias("c")).scalar()
    best = rows.filter(F.col("passes") & reduce(Column.__and__, [F.col(f"n{i}") > 0 for i in range(len(phrases))])).withColumns({"s": total, "c": counts})
    score = F.lit(0.0)
    for i in range(len(phrases)):
        score = score + bm25_term(idf(F.col("s.n").cast("double"), F.col(f"c.c{i}").cast("double")), F.col(f"tf{i}"), F.col("n_tokens").cast("double"), F.col("s.mean"))
    found = best.select(key, score.alias("relevance"))
    return found if limit is None else found.orderBy(F.desc("relevance"), key).limit(limit)


def search_blocks(
    held: DataFrame, held_blocks: DataFrame, stats: DataFrame, query: str, *, key: str = "id", filters: Column | None = None,
    weights: Mapping[str, float] = WEIGHTS, limit: int = CANDIDATES, report: Callable[[dict], None] = lambda found: None,
) -> DataFrame:
    """The rows of ``search_postings``, reading only slots that can still matter.

    ``blocks`` say how many rows have a token, so no posting is read for counts, in which slots all words of the
    query occur, and what a row of such a slot can score at best. Slots are read from the best on, in rounds that
    double; the worst of the best rows so far is a threshold that tightens with each round, and the search ends where
    no slot left can reach it. A tie at the threshold is still read. ``report`` gets slots, slots read and rounds.

    How often a phrase of several tokens occurs is known only from all its places: such a query is ``search_postings``.
    ``weights`` are those of the postings. What comes to the driver are the query's slots, a number for each, and the best rows.
    """
    phrases = phrases_of(query)
    if not phrases or any(len(p) > 1 for p in phrases):
        return search_postings(held, stats, query, key=key, filters=filters, weights=weights, limit=limit)
    words = [p[0] for p in phrases]
    tokens = sorted(set(words))
    own = _of_tokens(held_blocks, tokens)
    total = stats.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), (F.sum("tokens") / F.sum("rows")).alias("mean")).first()
    by_token = {r["token"]: r["c"] for r in own.groupBy("token").agg(F.sum("rows").alias("c")).collect()}
    out = held.select(key, F.lit(0.0).alias("relevance"))
    if len(by_token) < len(tokens):
        report({"slots": 0, "read": 0, "rounds": 0})
        return out.filter(F.lit(False))
    weight = {t: idf(F.lit(float(total["n"])), F.lit(float(by_token[t]))) for t in tokens}
    score = lambda tf, length: reduce(Column.__add__, [bm25_term(weight[w], tf(w), length.cast("double"), F.lit(total["mean"])) for w in words], F.lit(0.0))
    of = lambda t, c: F.max(F.when(F.col("token") == t, F.col(c)))
    slots = own.groupBy("slot").agg(*[of(t, "tf").alias(f"tf{i}") for i, t in enumerate(tokens)], F.least(*[of(t, "rows") for t in tokens], F.lit(1 << 60)).alias("rows"), F.max("least").alias("least"), F.count_distinct("token").alias("n"))
    best = score(lambda w: F.col(f"tf{tokens.index(w)}"), F.col("least"))
    bounds = slots.filter(F.col("n") == len(tokens)).select("slot", "rows", best.alias("bound")).orderBy(F.desc("bound"), "slot").collect()

    per_row = _of_tokens(held, tokens).filter("first").filter(F.lit(True) if filters is None else filters)
    found: list[tuple[float, object]] = []
    at, rounds, want = 0, 0, 4 * limit
    while at < len(bounds) and (len(found) < limit or bounds[at]["bound"] * (1 + 1e-9) >= found[limit - 1][0]):
        chunk, rows = [], 0
        while at < len(bounds) and rows < want:
            chunk.append(bounds[at]["slot"])
            rows += bounds[at]["rows"]
            at += 1
        some = per_row.filter(F.col("slot").isin(chunk)).groupBy(key, "n_tokens").agg(*[of(t, "tf").alias(f"tf{i}") for i, t in enumerate(tokens)], F.count_distinct("token").alias("n"))
        scored = some.filter(F.col("n") == len(tokens)).select(key, score(lambda w: F.col(f"tf{tokens.index(w)}"), F.col("n_tokens")).alias("relevance"))
        found += [(r["relevance"], r[key]) for r in scored.orderBy(F.desc("relevance"), key).limit(limit).collect()]
        found = sorted(found, key=lambda x: (-x[0], x[1]))[:limit]
        rounds, want = rounds + 1, 2 * want
    report({"slots": len(bounds), "read": at, "rounds": rounds})
    return held.sparkSession.createDataFrame([(k, r) for r, k in found], out.schema).orderBy(F.desc("relevance"), key)
