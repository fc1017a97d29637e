"""Embedding providers and the embedding of a text column."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

#: Width of a vector, texts in a request, seconds to wait.
DIMENSIONS, BATCH, TIMEOUT = 768, 32, 120.0
#: What the self-hosted model wants before a text.
DOCUMENT_PREFIX, QUERY_PREFIX = "search_document: ", "search_query: "


class Provider(Protocol):
    def documents(self, texts: Sequence[str]) -> list[list[float]]: ...

    def query(self, text: str) -> list[float]: ...


@dataclass(frozen=True)
class KeywordPresence:
    """One dimension for each keyword: 1 where the lower-cased text contains it. For tests and dry runs."""

    keywords: tuple[str, ...]

    def documents(self, texts: Sequence[str]) -> list[list[float]]:
        return [self.query(t) for t in texts]

    def query(self, text: str) -> list[float]:
        low = text.lower()
        return [float(k in low) for k in self.keywords]


def _post(url: str, payload: dict, timeout: float, key: str | None = None) -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(payload).encode(), headers), timeout=timeout) as response:
        return json.loads(response.read())


@dataclass(frozen=True)
class SelfHosted:
    """A model server that takes ``{model, input}`` and returns ``embeddings``; texts go in batches with prefixes."""

    url: str
    model: str
    batch: int = BATCH
    timeout: float = TIMEOUT

    def _embed(self, texts: Sequence[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), self.batch):
            out += _post(self.url, {"model": self.model, "input": list(texts[at : at + self.batch])}, self.timeout)["embeddings"]
        return out

    def documents(self, texts: Sequence[str]) -> list[list[float]]:
        return self._embed([DOCUMENT_PREFIX + t for t in texts])

    def query(self, text: str) -> list[float]:
        return self._embed([QUERY_PREFIX + text])[0]


@dataclass(frozen=True)
class Hosted:
    """A service with a bearer key that takes all texts in one request and returns ``data[].embedding``."""

    url: str
    model: str
    key: str
    dimensions: int = DIMENSIONS
    timeout: float = TIMEOUT

    def _embed(self, texts: Sequence[str]) -> list[list[float]]:
        got = _post(self.url, {"model": self.model, "input": list(texts), "dimensions": self.dimensions}, self.timeout, self.key)
        return [row["embedding"] for row in sorted(got["data"], key=lambda r: r.get("index", 0))]

    def documents(self, texts: Sequence[str]) -> list[list[float]]:
        return self._embed(texts) if texts else []

    def query(self, text: str) -> list[float]:
        return self._embed([text])[0]


def provider(kind: str, **settings: object) -> Provider:
    return {"self-hosted": SelfHosted, "hosted": Hosted, "keywords": KeywordPresence}[kind](**settings)


def embed(df: DataFrame, provider_: Provider, text: str = "text", name: str = "embedding", batch: int = BATCH) -> DataFrame:
    """``df`` with an ``array<float>`` column, embedded in Arrow batches inside each task."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, batch):
                part = whole.slice(begin, batch)
                vectors = provider_.documents([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32()))], [*part.schema.names, name])

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))]))
