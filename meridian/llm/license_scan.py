"""Licence scan: phrase places and an exact set-similarity join against licence templates.

Built from DataFrame functions alone. A template's words are ordered by how many text blocks hold
them, rarest first; a block that has at least the share ``threshold`` of them must hold one of the
first ``size - needed + 1``. These prefixes make the join's keys, block length and the words' places
in the order rule out most candidates, and the overlap of whole sets decides.

A block is a line, or consecutive words of the text over line ends: a template's own number of words
divided by ``threshold``, so that a wrapped notice fits with what comment marks put in between.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table, texts

#: Phrases that must stand word by word, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Well-known licence statements and notices; the label says which one a block contains.
TEMPLATES = {
    "apache-statement": "Licensed under the Apache License, Version 2.0.",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-statement": "Licensed under CC BY-NC 4.0.",
    "cc-by-statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-statement": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit-statement": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
}

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8


def template_words(templates: dict[str, str]) -> dict[str, list[str]]:
    import re

    return {name: sorted({w for w in re.split(SEPARATORS, text.lower()) if w}) for name, text in templates.items()}


def needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(round(threshold * size, 9)))


def template_widths(templates: dict[str, str], threshold: float) -> dict[str, int]:
    """Words of the blocks over line ends."""
    import re

    return {name: math.ceil(round(sum(map(bool, re.split(SEPARATORS, text.lower()))) / threshold, 9)) for name, text in templates.items()}


def _spaced(text: Column) -> Column:
    """Every word with a space on both sides: phrases then match as plain strings, and spaces count words.

    ``lower`` also changes letters beyond A-Z; none of them becomes a separator or a letter of a phrase.
    """
    words = F.trim(F.regexp_replace(F.lower(text), SEPARATORS, "  "))
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _words(spaced: Column) -> Column:
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("long")


def blocks(docs: DataFrame, vocabulary: list[str], least: int) -> DataFrame:
    """``doc_id, words``: of each line the distinct words that any template has, where there are enough."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    lines = texts(docs).where(F.col("text") != "").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    held = lines.select("doc_id", F.array_intersect(F.split(F.trim(F.regexp_replace(F.lower("line"), SEPARATORS, " ")), " "), known).alias("words"))
    return held.where(F.size("words") >= least)


def stretches(docs: DataFrame, sets: dict[str, list[str]], vocabulary: list[str], threshold: float, width: int) -> DataFrame:
    """``doc_id, words, run``: overlapping runs of words of the texts with several lines, so that each ``width`` consecutive
    words are in one; ``words`` are the distinct ones that any template has. Only runs that hold enough of a template
    in any order, of texts that do.
    """
    known = F.array(*[F.lit(w) for w in vocabulary])

    def enough(words: Column) -> Column:
        one = [F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in own]))) >= needed(len(own), threshold) for own in sets.values()]
        return (F.size(words) >= least) & F.coalesce(*[F.when(x, True) for x in one], F.lit(False))

    def held(words: Column) -> Column:
        return F.array_intersect(F.split(F.trim(words), " "), known)

    # filters inside generators, as one on a column would work the column out anew for each of its uses
    least = min(needed(len(w), threshold) for w in sets.values())
    flat = F.filter(F.array(F.regexp_replace(F.lower("text"), SEPARATORS, " ")), lambda x: F.exists(F.array(held(x)), enough))
    whole = texts(docs).where(F.contains("text", F.lit("\n"))).select("doc_id", F.explode(flat).alias("flat"))
    pieces = whole.select("doc_id", F.regexp_extract_all(F.trim("flat"), F.lit(rf"(?:[^ ]++ ?+){{1,{width}}}+"), F.lit(0)).alias("pieces"))
    joined = F.transform("pieces", lambda x, i: F.concat(x, F.coalesce(F.get("pieces", i + 1), F.lit(""))))
    runs = F.filter(F.transform(joined, lambda x: F.struct(held(x).alias("words"), F.split(F.trim(x), " ").alias("run"))), lambda x: enough(x["words"]))
    return pieces.select("doc_id", F.explode(runs).alias("x")).select("doc_id", "x.words", "x.run")


def template_matches(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, label, score``: every block that has at least ``threshold`` of a template's distinct words.

    The templates are a fixed parameter, so their words (a few hundred), the counts of these and the
    broadcast side of the join do not grow with the documents.
    """
    sets = template_words(TEMPLATES if templates is None else templates)
    sets = {name: words for name, words in sets.items() if words}
    vocabulary = sorted({w for words in sets.values() for w in words})
    spark = docs.sparkSession
    if not sets:
        return spark.createDataFrame([], "doc_id long, label string, score double")
    widths = template_widths(TEMPLATES if templates is None else templates, threshold)
    lines = blocks(docs, vocabulary, min(needed(len(w), threshold) for w in sets.values()))
    over = stretches(docs, sets, vocabulary, threshold, max(widths[name] for name in sets))
    held = table(lines.withColumn("run", F.lit(None).cast("array<string>")).unionByName(over), "blocks")
    counts = {r["word"]: r["n"] for r in held.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}

    rows = []
    for name, words in sets.items():
        order = sorted(rank[w] for w in words)
        n = needed(len(order), threshold)
        rows += [(name, token, at, len(order), n, order, words, widths[name]) for at, token in enumerate(order[: len(order) - n + 1])]
    prefixes = spark.createDataFrame(rows, "label string, token int, at int, size int, needed int, tokens array<int>, terms array<string>, width int")

    ranks = F.create_map(*[x for w, i in rank.items() for x in (F.lit(w), F.lit(i))])
    ordered = held.select("doc_id", F.array_sort(F.transform("words", lambda w: ranks[w])).alias("own"), "run")
    starts = F.array(*[F.lit(t) for t in sorted({r[1] for r in rows})])
    placed = ordered.where(F.arrays_overlap("own", starts)).select("doc_id", "own", "run", F.posexplode("own").alias("pos", "token"))
    joined = placed.join(F.broadcast(prefixes), "token")
    joined = joined.where((F.size("own") >= F.col("needed")) & (F.least(F.col("size") - F.col("at"), F.size("own") - F.col("pos")) >= F.col("needed")))
    joined = joined.withColumn("shared", F.size(F.array_intersect("own", "tokens"))).where(F.col("shared") >= F.col("needed"))
    firsts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("run") - F.col("width") + 1))
    most = F.array_max(F.transform(firsts, lambda i: F.size(F.array_intersect(F.slice("run", i, F.col("width")), F.col("terms")))))
    joined = joined.withColumn("shared", F.when(F.col("run").isNull(), F.col("shared")).otherwise(most)).where(F.col("shared") >= F.col("needed"))
    return joined.select("doc_id", "label", (F.col("shared") / F.col("size")).alias("score")).distinct()


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Null and empty texts have no words and no labels. score is 1 with a phrase, else the best
    template's share, else 0. Repeated rows of one doc_id each get their row. Extra columns are ignored.
    """
    spaced = texts(docs).select("doc_id", _spaced(F.col("text")).alias("spaced"))
    places, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        p = f" {phrase.replace(' ', '  ')} "
        there = F.contains("spaced", F.lit(p))
        without = F.length(F.replace("spaced", F.lit(p), F.lit("")))
        places.append(F.when(there, ((F.length("spaced") - without) / len(p)).cast("long")).otherwise(F.lit(0).cast("long")))
        firsts.append(F.when(there, _words(F.substring_index("spaced", p, 1))))
        after = _words(F.substring_index("spaced", p, -1))
        lasts.append(F.when(there, F.col("n_words") - after - len(phrase.split())))
        labels.append(F.when(there, F.lit(label)))
    counted = spaced.select("doc_id", "spaced", _words(F.col("spaced")).alias("n_words"))
    base = counted.select(
        "doc_id", "n_words", sum(places[1:], places[0]).alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"),
        F.array_sort(F.array_compact(F.array(*labels))).alias("base"),
    )
    found = template_matches(docs, templates, threshold).groupBy("doc_id").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    both = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return base.join(found, "doc_id", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The query's rows as DuckDB SQL: lines and runs over line ends, without the join's filters."""
    widths = template_widths(TEMPLATES, threshold)
    rows = ", ".join(f"('{name}', {words!r}, {needed(len(words), threshold)}, {widths[name]})" for name, words in template_words(TEMPLATES).items())
    spaced = rf"CASE WHEN trim(w) = '' THEN '' ELSE ' ' || trim(w) || ' ' END"
    phrases = [(f" {p.replace(' ', '  ')} ", label, len(p.split())) for p, label in PHRASES.items()]
    places = " + ".join(f"(length(s) - length(replace(s, '{p}', ''))) // {len(p)}" for p, _, _ in phrases)
    count = lambda x: f"(length({x}) - length(replace({x}, ' ', ''))) // 2"
    first = ", ".join(f"CASE WHEN contains(s, '{p}') THEN {count(f"string_split(s, '{p}')[1]")} END" for p, _, _ in phrases)
    last = ", ".join(f"CASE WHEN contains(s, '{p}') THEN {count('s')} - {count(f"string_split(s, '{p}')[-1]")} - {n} END" for p, _, n in phrases)
    base = ", ".join(f"CASE WHEN contains(s, '{p}') THEN '{label}' END" for p, label, _ in phrases)
    return rf"""
WITH t AS (SELECT * FROM (VALUES {rows}) v(label, words, needed, width)),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_replace(lower(text), '{SEPARATORS}', '  ', 'g') AS w FROM d),
s AS (SELECT doc_id, {spaced} AS s FROM w),
b AS (SELECT doc_id, {count('s')} AS n_words, {places} AS n_base, least({first}) AS first_word, greatest({last}) AS last_word,
  list_sort(list_filter([{base}], lambda x: x IS NOT NULL)) AS base FROM s),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
k AS (SELECT DISTINCT doc_id, list_distinct(string_split(trim(regexp_replace(lower(line), '{SEPARATORS}', ' ', 'g')), ' ')) AS own FROM l),
o AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '{SEPARATORS}', ' ', 'g')), ' ') AS run FROM d WHERE contains(text, chr(10))),
u AS (SELECT doc_id, label, words, needed, width, run, unnest(range(1, greatest(1, len(run) - width + 1) + 1)) AS i FROM o, t WHERE len(list_intersect(list_distinct(run), words)) >= needed),
m AS (SELECT doc_id, label, len(list_intersect(own, words)) / len(words)::DOUBLE AS score FROM k, t WHERE len(list_intersect(own, words)) >= needed
  UNION ALL SELECT doc_id, label, len(list_intersect(list_distinct(run[i:i + width - 1]), words)) / len(words)::DOUBLE FROM u WHERE len(list_intersect(list_distinct(run[i:i + width - 1]), words)) >= needed),
f AS (SELECT doc_id, list(DISTINCT label) AS more, max(score) AS best FROM m GROUP BY doc_id)
SELECT b.doc_id, n_words::BIGINT AS n_words, n_base::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(base, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM b LEFT JOIN f USING (doc_id)
"""
