"""Token counts of fields and sections, from one encoding of the whole document.

Encoding a field by itself gives other tokens at its edges. So the document is encoded once, every
token's span is joined with the spans of the sections, and a token over a boundary is allocated by a
stated rule.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tidy

#: Rules for a token over a boundary: all to the section of its first byte, of its last byte, of most
#: of its bytes (the earlier one of equals), or to each its share of the bytes.
RULES = ("first", "last", "most", "share")
_loaded: dict[tuple[str, str], tuple] = {}


def _encoding(path: str, pattern: str) -> tuple:
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            lengths[i] = len(token)
        _loaded[path, pattern] = (tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths)
    return _loaded[path, pattern]


def allocate(tokens: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of the tokens that touch it cross a boundary.

    Both arguments are ends in bytes, ascending; tokens and sections each cover the whole document.
    Empty sections get nothing.
    """
    n, k = len(tokens), len(sections)
    begins = np.concatenate([[0], tokens[:-1]]) if n else tokens
    first, last = np.searchsorted(sections, begins, "right"), np.searchsorted(sections, tokens - 1, "right")
    over = np.flatnonzero(first != last)
    crossing = np.zeros(k + 1, np.int64)
    filled = np.diff(sections, prepend=0) > 0
    for i in over.tolist():
        crossing[first[i] : last[i] + 1] += filled[first[i] : last[i] + 1]
    if rule == "share":
        got = np.interp(sections, np.concatenate([[0], tokens]), np.arange(n + 1)) if n else np.zeros(k)
        return np.diff(got, prepend=0.0), crossing[:k]
    owner = {"first": first, "last": last, "most": first.copy()}[rule]
    if rule == "most":
        for i in over.tolist():
            edges = np.clip(sections[first[i] : last[i] + 1], begins[i], tokens[i])
            owner[i] = first[i] + int(np.diff(edges, prepend=begins[i]).argmax())
    return np.bincount(owner, minlength=k)[:k].astype(np.float64), crossing[:k]


def attribute(docs: DataFrame, vocabulary: str, pattern: str, fields: Sequence[str] = ("text",), rule: str = "first", lines: bool = True) -> DataFrame:
    """``doc_id, field, section, start, end, n_tokens, n_crossing``: a row for each section of each document.

    The document is its fields in order, each but the last followed by a line end. With ``lines``
    every line of a field is a section, else the field is one; a line end belongs to the line
    before it. start and end are code points in the document, and a document's n_tokens add up to
    its tokens. A null field is empty and still has its one empty section. Repeated rows each give
    their sections; extra columns are ignored; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = _encoding(vocabulary, pattern)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            columns = [batch.column(f"f{i}").to_pylist() for i in range(len(names))]
            for doc, *values in zip(batch.column("doc_id").to_pylist(), *columns, strict=True):
                whole = "\n".join(values)
                data = np.frombuffer(whole.encode(), np.uint8)
                tokens = np.cumsum(lengths[encoding.encode_to_numpy(whole, disallowed_special=())])
                breaks = np.flatnonzero(data == 10) + 1
                ends, of, number = [], [], []
                at = 0
                for i, value in enumerate(values):
                    end = min(at + len(value.encode()) + 1, len(data)) if i < len(values) - 1 else len(data)
                    if lines:
                        inner = breaks[(breaks > at) & (breaks < end + (i == len(values) - 1))]
                        own = [*inner.tolist(), end]
                    else:
                        own = [end]
                    ends += own
                    of += [names[i]] * len(own)
                    number += range(len(own))
                    at = end
                bounds = np.array(ends, np.int64)
                counts, crossing = allocate(tokens, bounds, rule)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                stops = chars[bounds]
                for column, more in zip(out, ([doc] * len(ends), of, number, np.concatenate([[0], stops[:-1]]), stops, counts, crossing), strict=True):
                    column.extend(more)
                if len(out[0]) > 50_000:
                    yield _batch(out)
                    out = [[] for _ in range(7)]
            yield _batch(out)

    columns = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{i}") for i, f in enumerate(names)]
    schema = "doc_id long, field string, section int, start long, end long, n_tokens double, n_crossing long"
    return docs.select(F.col("doc_id").cast("long"), *columns).mapInArrow(tidy(run), schema)


def _batch(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "field", "section", "start", "end", "n_tokens", "n_crossing"])
