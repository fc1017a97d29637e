"""JSON over HTTP: a Spark data source for a few named URLs, a stream of them that are visited again and again, and a
step over a table of many.

Each host is in one partition, so a host never serves two requests at once and its minimum interval is
kept by the one task that reads it, or between batches by the stream: how fast a single host is read does not
depend on the cluster. No more than ``workers`` hosts are read at once.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from meridian.functions.text import host_of
from meridian.operators.bookkeeping import interleaved
from meridian.schemas import DOCUMENTS

#: Three attempts, the least seconds between two requests to a host, what chance adds, the time a request has, and
#: how many hosts are read at once.
RETRIES, MIN_INTERVAL, JITTER, TIMEOUT, WORKERS = 2, 2.0, 1.0, 30.0, 3


def get_text(url: str, retries: int = RETRIES, timeout: float = TIMEOUT, sleep: Callable[[float], None] = time.sleep, opener=urllib.request.urlopen) -> str:
    """Body of a URL. Transport errors, 429 and server errors are tried again after 1, 2, 4 … seconds;
    other client errors are raised at once."""
    for attempt in range(retries + 1):
        try:
            with opener(url, timeout=timeout) as response:
                return response.read().decode("utf-8")
        except urllib.error.HTTPError as e:
            if e.code != 429 and e.code < 500 or attempt == retries:
                raise
        except OSError:
            if attempt == retries:
                raise
        sleep(2.0**attempt)
    raise AssertionError("unreachable")


class HostPartition(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


class HttpReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = json.loads(options["urls"])
        self.retries = int(options.get("retries", RETRIES))
        self.interval = float(options.get("interval", MIN_INTERVAL))
        self.jitter = float(options.get("jitter", JITTER))
        self.timeout = float(options.get("timeout", TIMEOUT))

    def partitions(self) -> list[HostPartition]:
        hosts: dict[str, list[str]] = {}
        for url in dict.fromkeys(self.urls):
            hosts.setdefault(urlsplit(url).netloc, []).append(url)
        return [HostPartition(urls) for urls in hosts.values()]

    def read(self, partition: HostPartition, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple]:
        free: dict[str, float] = {}
        for url in partition.urls:
            host = urlsplit(url).netloc
            if (wait := free.get(host, 0.0) - clock()) > 0:
                sleep(wait)
            yield self.one(url)
            free[host] = clock() + self.interval + (random.uniform(0, self.jitter) if self.interval else 0.0)

    def one(self, url: str) -> tuple:
        try:
            body = get_text(url, self.retries, self.timeout)
            json.loads(body)
            return url, body, None
        except (OSError, ValueError) as e:
            return url, None, f"{type(e).__name__}: {e}"


class HttpStream(DataSourceStreamReader):
    """Documents of URLs that are visited again every so many seconds.

    An offset is a moment, counted in minimum intervals: URL i of a host is due i intervals after each of the host's
    rounds begins, and a round takes ``every`` seconds, or as long as the host's URLs need. What is due between two
    offsets follows from these alone, so a restarted query fetches what the one before had planned, nothing of it
    twice and nothing left out. A new query begins a whole round in the past: everything is due at once. Visits that
    were missed while no query ran count as one.

    A batch has at most ``workers`` partitions. The hosts are dealt to them and take turns there, so a host is in one
    partition and no more than ``workers`` requests are made at once.
    """

    def __init__(self, options: dict, clock: Callable[[], float] = time.time) -> None:
        self.fetcher, self.clock = HttpReader(options), clock
        self.hosts: dict[str, list[str]] = {}
        for url in dict.fromkeys(self.fetcher.urls):
            self.hosts.setdefault(urlsplit(url).netloc, []).append(url)
        self.workers = int(options.get("workers", WORKERS))
        self.tick = max(self.fetcher.interval, 0.1)
        self.round = max(1, round(float(options.get("every", 3600.0)) / self.tick))

    def _length(self, host: str) -> int:
        return max(self.round, len(self.hosts[host]))

    def initialOffset(self) -> dict:  # noqa: N802
        longest = max((self._length(host) for host in self.hosts), default=0)
        return {"tick": int(self.clock() // self.tick) - longest}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"tick": int(self.clock() // self.tick)}

    def due(self, host: str, after: int, until: int) -> list[str]:
        """The host's URLs that are due after one offset and until another, each once, in the order in which they last are."""
        urls, length = self.hosts[host], self._length(host)
        ticks = range(max(after, until - length) + 1, until + 1)
        return [urls[i] for i in (tick % length for tick in ticks) if i < len(urls)]

    def partitions(self, start: dict, end: dict) -> list[HostPartition]:
        busy = [urls for host in self.hosts if (urls := self.due(host, start["tick"], end["tick"]))]
        parts: list[list[str]] = []
        for worker in range(min(self.workers, len(busy))):
            mine = busy[worker :: self.workers]
            parts.append([urls[turn] for turn in range(max(map(len, mine))) for urls in mine if turn < len(urls)])
        return [HostPartition(urls) for urls in parts]

    def read(self, partition: HostPartition) -> Iterator[tuple]:
        return self.fetcher.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept beside the offsets."""


class HttpJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_json"

    def schema(self):
        return DOCUMENTS

    def reader(self, schema) -> HttpReader:
        return HttpReader(self.options)

    def streamReader(self, schema) -> HttpStream:  # noqa: N802
        return HttpStream(self.options)


def fetch(spark: SparkSession, urls: list[str], **options: object) -> DataFrame:
    """``url, body, error`` of each distinct URL."""
    spark.dataSource.register(HttpJson)
    reader = spark.read.format("http_json").option("urls", json.dumps(urls))
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()


def fetch_stream(spark: SparkSession, urls: list[str], **options: object) -> DataFrame:
    """``url, body, error`` as a stream over the URLs, round after round; see ``HttpStream`` for the options."""
    spark.dataSource.register(HttpJson)
    reader = spark.readStream.format("http_json").option("urls", json.dumps(urls))
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()


def fetch_table(urls: DataFrame, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, workers: int = WORKERS, **options: object) -> DataFrame:
    """``url, body, error`` of each distinct ``urls(url)``, fetched by the tasks that hold them: no URL comes to the driver.

    Hosts are dealt to ``workers`` tasks, so no more requests are made at once, and in a task they take turns, so
    that one host's interval passes while others are read.
    """
    reader = HttpReader({"urls": "[]", **{k: str(v) for k, v in options.items()}})
    turns = interleaved(urls.select("url").where("url is not null").distinct(), F.coalesce(host_of(F.col("url")), F.lit("")), "url")
    dealt = turns.repartition(workers, "host").sortWithinPartitions("turn", "host_first").select("url", "host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free: dict[str, float] = {}
        for batch in batches:
            for url, host in zip(batch.column("url").to_pylist(), batch.column("host").to_pylist(), strict=True):
                if (wait := free.get(host, 0.0) - clock()) > 0:
                    sleep(wait)
                row = reader.one(url)
                free[host] = clock() + reader.interval + (random.uniform(0, reader.jitter) if reader.interval else 0.0)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in row], ["url", "body", "error"])

    return dealt.mapInArrow(run, DOCUMENTS)


def landed(spark: SparkSession, path: str) -> DataFrame:
    """Documents that were saved as files: one whole file is a document, its path the URL."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("body"), F.lit(None).cast("string").alias("error"))
