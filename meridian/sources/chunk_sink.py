"""A vector store as a sink: chunks are put in by key, taken out by a condition, and searched.

Each task writes a file of its own and says its name; the driver's commit adds the names to a manifest, the one step that
counts. Files have their job's name: an abort takes away all of them, also those of tasks that were killed and said nothing, and
leaves a mark by which a task that still writes knows to take its own away. What is left nevertheless is in no manifest. A stream's batch that comes again finds its number in the manifest and changes nothing. Of several rows of a key
the newest counts; a deletion is a row too, until ``compact`` writes what is left. A store has one writer at a time.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from meridian.operators import vector

FORMAT, KEY, DELETED = "chunk_store", "chunk_key", "deleted"


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def manifest(path: str) -> dict:
    """The newest manifest: ``version``, ``files`` with the version of each, the ``batches`` taken of each stream."""
    fs, root = _at(path)
    names = [f.base_name for f in fs.get_file_info(pafs.FileSelector(f"{root}/manifest", allow_not_found=True)) if f.base_name.endswith(".json")]
    if not names:
        return {"version": 0, "files": {}, "batches": {}}
    with fs.open_input_stream(f"{root}/manifest/{max(names)}") as f:
        return json.loads(f.read())


def _publish(path: str, held: dict) -> None:
    fs, root = _at(path)
    fs.create_dir(f"{root}/manifest")
    beside = f"{root}/manifest/{uuid.uuid4().hex}"
    with fs.open_output_stream(beside) as f:
        f.write(json.dumps(held).encode())
    fs.move(beside, f"{root}/manifest/{held['version']:012d}.json")


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class _Files:
    """What batch and stream writers share."""

    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.stream, self.schema = options["path"], options.get("stream", ""), to_arrow_schema(schema)
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _at(self.path)
        fs.create_dir(f"{root}/data")
        name = f"{self.job}-{uuid.uuid4().hex}.parquet"
        where, rows = f"{root}/data/{name}", 0
        try:
            with pq.ParquetWriter(where, self.schema, filesystem=fs) as out:
                self._stands(fs, root)
                for batch in iterator:
                    out.write_batch(pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(batch.columns, self.schema.types, strict=True)], schema=self.schema))
                    rows += batch.num_rows
            self._stands(fs, root)
        except BaseException:
            with contextlib.suppress(FileNotFoundError):
                fs.delete_file(where)
            raise
        return Written(name, rows)

    def _stands(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/aborted/{self.job}").type != pafs.FileType.NotFound:
            raise InterruptedError("the job was aborted")

    def withdraw(self) -> None:
        """The mark first, then the files: one that is made after the look at them is made by a task that sees the mark."""
        fs, root = _at(self.path)
        fs.create_dir(f"{root}/aborted")
        with fs.open_output_stream(f"{root}/aborted/{self.job}") as f:
            f.write(b"")
        held = manifest(self.path)["files"]
        for info in fs.get_file_info(pafs.FileSelector(f"{root}/data", allow_not_found=True)):
            if info.base_name.startswith(self.job) and info.base_name not in held:
                with contextlib.suppress(FileNotFoundError):
                    fs.delete_file(info.path)

    def remove(self, messages: Sequence[Written | None]) -> None:
        fs, root = _at(self.path)
        for m in messages:
            if m is not None:
                with contextlib.suppress(FileNotFoundError):
                    fs.delete_file(f"{root}/data/{m.name}")

    def publish(self, messages: Sequence[Written | None], batch: int | None = None) -> None:
        held = manifest(self.path)
        if batch is not None and held["batches"].get(self.stream, -1) >= batch:
            self.remove(messages)
            return
        version = held["version"] + 1
        files = held["files"] | {m.name: version for m in messages if m is not None and m.rows}
        batches = held["batches"] if batch is None else held["batches"] | {self.stream: batch}
        _publish(self.path, {"version": version, "files": files, "batches": batches})


class ChunkWriter(DataSourceArrowWriter):
    def __init__(self, files: _Files) -> None:
        self.files = files

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.files.write(iterator)

    def commit(self, messages: list) -> None:
        self.files.publish(messages)

    def abort(self, messages: list) -> None:
        self.files.withdraw()


class ChunkStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, files: _Files) -> None:
        self.files = files

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.files.write(iterator)

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.files.publish(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.files.withdraw()


class ChunkSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(_Files(dict(self.options), schema))

    def streamWriter(self, schema: StructType, overwrite: bool) -> ChunkStreamWriter:  # noqa: N802
        return ChunkStreamWriter(_Files(dict(self.options), schema))


@dataclass(frozen=True)
class ChunkStore:
    """``columns`` is the DDL of the chunks, which have a ``chunk_key``."""

    spark: SparkSession
    path: str
    columns: str

    def __post_init__(self) -> None:
        self.spark.dataSource.register(ChunkSink)

    def _write(self, rows: DataFrame, deleted: bool) -> None:
        rows.withColumn(DELETED, F.lit(deleted)).write.format(FORMAT).mode("append").option("path", self.path).save()

    def upsert(self, chunks: DataFrame) -> None:
        """Put in chunks with distinct keys; they take the place of what had their keys."""
        self._write(chunks.select(*self.current().columns), False)

    def upsert_stream(self, chunks: DataFrame, checkpoint: str, name: str):
        """The same for a stream, whose ``name`` tells its batches from those of others. Keys are distinct in a batch."""
        rows = chunks.select(*self.current().columns).withColumn(DELETED, F.lit(False))
        return rows.writeStream.format(FORMAT).option("path", self.path).option("stream", name).option("checkpointLocation", checkpoint)

    def delete_where(self, condition: Column) -> None:
        """Take out what meets the condition, as the store is now."""
        gone = self.current().filter(condition)
        none = [F.lit(None).cast(t).alias(c) for c, t in gone.dtypes if c != KEY]
        self._write(gone.select(KEY, *none).select(*gone.columns), True)

    def current(self) -> DataFrame:
        """The chunks that count. After ``compact``, and before anything is written over, files are read as they are."""
        held = manifest(self.path)
        schema = f"{self.columns}, {DELETED} boolean"
        if not held["files"]:
            return self.spark.createDataFrame([], self.columns)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{name}" for name in held["files"]])
        if len(set(held["files"].values())) == 1:
            return rows.filter(f"not {DELETED}").drop(DELETED)
        names = self.spark.createDataFrame(list(held["files"].items()), "file string, version long")
        versions = rows.select("*", F.col("_metadata.file_name").alias("file")).join(names, "file").drop("file")
        newest = versions.groupBy(KEY).agg(F.max_by(F.struct(*rows.columns), "version").alias("r")).select("r.*")
        return newest.filter(f"not {DELETED}").drop(DELETED)

    def compact(self) -> None:
        """Write what counts into files of its own and delete all others, and the marks of aborted jobs."""
        before = manifest(self.path)
        self._write(self.current(), False)
        after = manifest(self.path)
        files = {name: v for name, v in after["files"].items() if v > before["version"]}
        _publish(self.path, {**after, "version": after["version"] + 1, "files": files})
        fs, root = _at(self.path)
        for info in fs.get_file_info(pafs.FileSelector(f"{root}/data", allow_not_found=True)):
            if info.base_name not in files:
                fs.delete_file(info.path)
        fs.delete_dir_contents(f"{root}/aborted", missing_dir_ok=True)

    def search(self, query: Sequence[float], **how: object) -> DataFrame:
        """``vector.nearest`` over the chunks that count."""
        return vector.nearest(self.current(), query, **how)
