r"""How the sources of a language differ in their words, by SQL over shards.

Tasks read texts and count terms of their own rows in DuckDB. Counts of one language and term meet in
one partition, sorted by a hash of the two, so that SQL sums them and keeps the frequent terms a block
of whole terms at a time, however large the partition. The kept counts are dealt to shards by
a hash of language and term, each with all groups' totals; a shard's SQL fills in the terms that a
group lacks, sums the differences of every two groups of a language, and ranks its own terms. Spark
adds the shards' sums and ranks once more. What meets by key is never more than counts: a source that
has a third of all rows gives as many counts as any other.

All numbers are whole: a share is a number of billionths.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import binary_column, discard, segments, table, tidy

#: Fixed value: a term is letters A to Z and whatever is beyond ASCII; A-Z are lower-cased before.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows that a task's DuckDB holds before they are summed, and given out if three quarters stay.
HELD = 400_000
#: Counts of one block of terms.
BLOCK = 200_000
#: Bytes of text whose terms are counted at once.
PART = 1 << 20
#: Terms times groups of one shard.
SHARD = 200_000


def _session() -> duckdb.DuckDBPyConnection:
    """In memory, one thread, nothing on a local disk."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": "", "preserve_insertion_order": False})


def _batches(con: duckdb.DuckDBPyConnection, sql: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in con.execute(sql).to_arrow_reader(20_000):
        yield from pa.Table.from_batches([batch]).cast(schema).to_batches()


def _parts(batches: Iterator[pa.RecordBatch], size: int = PART) -> Iterator[tuple[pa.Table, bool]]:
    """Rows of about ``size`` bytes of text, A-Z lower-cased (``bytes.lower`` touches only these), and whether it is a stretch of one longer text."""
    names, rows, held = ["row", "lang", "source", "text"], [], 0

    def tabled(rows: list[tuple]) -> pa.Table:
        columns = list(zip(*rows, strict=True))
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.binary()).cast(pa.string())], names)

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), binary_column(batch, "text"), strict=True):
            if len(text) > size:
                for i, part in enumerate(segments(text, size)):
                    yield tabled([(i, lang, source, part.lower())]), True
                yield tabled([(-1, lang, source, b"")]), True
                continue
            rows.append((len(rows), lang, source, text.lower()))
            held += len(text)
            if held > size:
                yield tabled(rows), False
                rows, held = [], 0
    if rows:
        yield tabled(rows), False


_TERMS = f"SELECT row, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM part"
_SUMS = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM met GROUP BY ALL"
_LISTS = "SELECT lang, term, sum(docs)::BIGINT AS docs, list(source) AS sources, list(n) AS counts FROM met GROUP BY lang, term"
#: The same of counts that are lists already.
_LISTS_OF_LISTS = """
WITH each AS (SELECT lang, term, unnest(sources) AS source, unnest(counts) AS n FROM part), summed AS (SELECT lang, term, source, sum(n)::BIGINT AS n FROM each GROUP BY ALL)
SELECT d.lang, d.term, d.docs, s.sources, s.counts FROM (SELECT lang, term, sum(docs)::BIGINT AS docs FROM part GROUP BY ALL) d
JOIN (SELECT lang, term, list(source) AS sources, list(n) AS counts FROM summed GROUP BY ALL) s ON s.lang = d.lang AND s.term = d.term
"""
_COUNTS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_KEPT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("first", pa.int64())])


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, term, docs, sources, counts``: each task's own counts; the empty term stands for the documents of each source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _session()
        con.execute("CREATE TABLE met(lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT); CREATE TABLE long(lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT)")
        for part, stretch in _parts(batches):
            con.register("part", part)
            if not stretch:
                con.execute(f"INSERT INTO met SELECT lang, source, term, sum(n), count(*) FROM (SELECT row, lang, source, term, count(*) AS n FROM ({_TERMS}) GROUP BY ALL) GROUP BY lang, source, term")
                con.execute("INSERT INTO met SELECT lang, source, '', 0, count(*) FROM part GROUP BY ALL")
            elif part["row"][0].as_py() >= 0:
                con.execute(f"INSERT INTO long SELECT lang, source, term, count(*) FROM ({_TERMS}) GROUP BY ALL")
                if con.execute("SELECT count(*) FROM long").fetchall()[0][0] > HELD:
                    con.execute("CREATE OR REPLACE TABLE long AS SELECT lang, source, term, sum(n)::BIGINT AS n FROM long GROUP BY ALL")
            else:  # a long text is over: it counts as one document
                con.execute("INSERT INTO met SELECT lang, source, term, sum(n), 1 FROM long GROUP BY ALL; DELETE FROM long")
                con.execute("INSERT INTO met SELECT lang, source, '', 0, 1 FROM part")
            con.unregister("part")
            if con.execute("SELECT count(*) FROM met").fetchall()[0][0] > HELD:
                con.execute(f"CREATE OR REPLACE TABLE met AS {_SUMS}")
                if con.execute("SELECT count(*) FROM met").fetchall()[0][0] > HELD * 3 // 4:
                    yield from _batches(con, _LISTS, _COUNTS)
                    con.execute("DELETE FROM met")
        con.execute(f"CREATE OR REPLACE TABLE met AS {_SUMS}")
        yield from _batches(con, _LISTS, _COUNTS)
        con.close()

    wanted = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    return docs.select(*wanted).mapInArrow(tidy(run), "lang string, term string, docs long, sources array<string>, counts array<long>")


def kept_counts(counts: DataFrame, least: int) -> DataFrame:
    """``lang, source, term, n, first``: sums of the terms in at least ``least`` documents of their language; ``first`` is 1
    in one row of each term. The empty term stays for each source."""

    often = f"SELECT lang, term FROM part GROUP BY lang, term HAVING term = '' OR sum(docs) >= {least}"
    each = f"SELECT lang, term, unnest(sources) AS source, unnest(counts) AS n FROM part SEMI JOIN ({often}) o USING (lang, term)"
    first = "CASE WHEN term <> '' AND source = min(source) OVER (PARTITION BY lang, term) THEN 1 ELSE 0 END::BIGINT AS first"
    sums = f"SELECT lang, source, term, n, {first} FROM (SELECT lang, source, term, sum(n)::BIGINT AS n FROM ({each}) GROUP BY ALL)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _session()
        held, size = [], 0

        def asked(part: pa.Table, sql: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
            con.register("part", part)
            yield from _batches(con, sql, schema)
            con.unregister("part")

        for batch in batches:
            held.append(batch)
            size += len(batch.column("sources").flatten())
            if size > BLOCK:
                part = pa.Table.from_batches(held)
                keys = part["key"].to_numpy()
                last = keys[-1]  # only of its terms can there be more
                yield from asked(part.slice(0, np.searchsorted(keys, last)), sums, _KEPT)
                rest = part.filter(pa.array(keys == last))
                if rest.num_rows > 1:
                    summed = pa.Table.from_batches(asked(rest, _LISTS_OF_LISTS, _COUNTS), _COUNTS)
                    rest = summed.append_column("key", pa.array(np.full(summed.num_rows, last))).cast(part.schema)
                held, size = rest.to_batches(), 0
        if held:
            yield from asked(pa.Table.from_batches(held), sums, _KEPT)
        con.close()

    sorted_ = counts.repartition("lang", "term").withColumn("key", F.xxhash64("lang", "term")).sortWithinPartitions("key")
    return sorted_.mapInArrow(tidy(run), "lang string, source string, term string, n long, first long")


_SHARE = "1 + (1000000000::HUGEINT * ({count} + 5) // ({total} + 5 * terms))::BIGINT"
#: Every term of the shard with every group of its language.
_DENSE = f"""
CREATE TABLE dense AS
WITH term AS (SELECT lang, term, sum(n) AS n FROM kept WHERE term <> '' GROUP BY ALL),
c AS (SELECT g.lang, g.source, t.term, coalesce(k.n, 0) AS n, g.total, g.lang_total, g.terms, t.n AS lang_n
  FROM term t JOIN held g USING (lang) LEFT JOIN kept k ON k.lang = t.lang AND k.term = t.term AND k.source = g.source)
SELECT lang, source, term, n, {_SHARE.format(count="n", total="total")} AS p, {_SHARE.format(count="lang_n", total="lang_total")} AS q FROM c
"""
_PAIRS = "SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL"
_NO_TERMS = "SELECT a.lang, a.source, b.source AS item, 0::BIGINT AS value FROM held a JOIN held b ON a.lang = b.lang AND a.source < b.source"
_TOP = """
SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM dense WHERE n > 0 AND p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {top}
"""
_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def divergences(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source of a language is from each other one (part ``pair``),
    and which terms it has more often than the language (part ``term``, the ``top`` first).

    Null texts, languages and sources are empty strings, and these are a text, a language and a source like
    any other. A group without terms has pairs, and 0 in all of them where its language keeps no term. Ties go by
    item. Repeated rows count each. Very long texts are counted in stretches and are one document each. Extra
    columns are ignored; an empty table gives no rows.
    """
    kept = table(kept_counts(term_counts(docs), least), "kept")
    sizes = table(kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("terms")), "sizes")
    langs = sizes.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("terms").alias("terms"))
    groups = table(sizes.select("lang", "source", "total").join(langs, "lang"), "groups")
    discard(sizes)
    dense = groups.agg(F.coalesce(F.sum("terms"), F.lit(0))).first()[0]
    shards = max(1, -(-dense // SHARD))
    words = kept.where("term <> ''").withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)))
    every = groups.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        con = _session()
        con.register("kept", left.select(["lang", "source", "term", "n"]))
        con.register("held", right.select(["lang", "source", "total", "lang_total", "terms"]))
        con.execute(_DENSE)
        pairs = f"({_PAIRS})" + (f" UNION ALL ({_NO_TERMS})" if right["shard"][0].as_py() == 0 else "")
        con.execute(f"CREATE TABLE pairs AS SELECT lang, source, item, sum(value)::BIGINT AS value FROM ({pairs}) GROUP BY ALL")
        both = "SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, item, 'pair', source, value FROM pairs"
        out = con.execute(f"{both} UNION ALL ({_TOP.format(top=top)})").to_arrow_table().cast(_FOUND)
        con.close()
        return out

    found = table(words.groupBy("shard").cogroup(every.groupBy("shard")).applyInArrow(run, "lang string, source string, part string, item string, value long"), "found")
    discard(kept, groups)
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    summed = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    terms = found.where("part = 'term'").withColumn("rank", place).where(F.col("rank") <= top)
    return summed.withColumn("rank", place).unionByName(terms)


def oracle_sql(least: int = 30, top: int = 50) -> str:
    """The query's rows as DuckDB SQL over all terms at once."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    share = lambda n, total: f"1 + (1000000000::HUGEINT * ({n} + 5) // ({total} + 5 * v))::BIGINT"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '{TERM}')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {least}),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT d.lang, d.source, coalesce(any_value(l.v), 0) AS v, coalesce(any_value(l.total), 0) AS lang_total, coalesce(any_value(s.total), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN l ON l.lang = d.lang LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) s ON s.lang = d.lang AND s.source = d.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {share("coalesce(c.n, 0)", "g.total")} AS p, {share("k.n", "g.lang_total")} AS q
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM x
QUALIFY part = 'pair' OR rank <= {top}
"""
