"""Tables whose writes become visible as a whole: part files and one manifest that names those which count.

    committed.register(spark)
    df.write.format("committed").mode("append").save(path)            # or overwrite
    stream.writeStream.format("committed").option("checkpointLocation", c).start(path)
    committed.read(spark, path)

Tasks write part files that no manifest names. The driver's commit replaces the manifest at once, so a reader sees a table
before or after a write, and an overwrite may read the table it replaces. For streams the manifest also keeps the last batch of
each stream: a batch that is run again after a crash writes nothing twice. Files of failed jobs are deleted on abort; those of a
killed driver are never named. One driver at a time writes a table, as for a streaming checkpoint.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from cadence.sources.archives import opened
from cadence.sources.sinks import newest

NAME, MANIFEST = "committed", "_manifest.json"
#: Rows of a part file.
FILE_ROWS = 4_000_000


@dataclass
class Parts(WriterCommitMessage):
    files: list[str] = field(default_factory=list)


def manifest(path: str) -> dict:
    """{"files": [...], "streams": {id: last batch}, "schema": ...} of a table, empty for none."""
    system, root = opened(path)
    if system.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.File:
        return {"files": [], "streams": {}, "schema": None}
    with system.open_input_stream(f"{root}/{MANIFEST}") as file:
        return json.loads(file.read())


def _replace(path: str, now: dict) -> None:
    system, root = opened(path)
    system.create_dir(root)
    temporary = f"{root}/_{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as file:
        file.write(json.dumps(now).encode())
    system.move(temporary, f"{root}/{MANIFEST}")


def _delete(path: str, files: list[str]) -> None:
    system, root = opened(path)
    for f in files:
        if system.get_file_info(f"{root}/{f}").type == fs.FileType.File:
            system.delete_file(f"{root}/{f}")


def _write_parts(path: str, batches: Iterator[pa.RecordBatch]) -> Parts:
    """Part files of a task, a batch in memory at a time."""
    system, root = opened(path)
    system.create_dir(f"{root}/data")
    done, writer, rows = Parts(), None, 0
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                done.files.append(f"data/part-{uuid.uuid4().hex}.parquet")
                writer, rows = pq.ParquetWriter(system.open_output_stream(f"{root}/{done.files[-1]}"), batch.schema, compression="zstd"), 0
            writer.write_batch(batch)
            rows += batch.num_rows
            if rows >= FILE_ROWS:
                writer.close()
                writer = None
    except BaseException:
        if writer is not None:
            writer.close()
        _delete(path, done.files)
        raise
    if writer is not None:
        writer.close()
    return done


def _files(messages: list[Parts | None]) -> list[str]:
    return [f for m in messages if m for f in m.files]


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool) -> None:
        self.path, self.schema, self.overwrite = options["path"], schema.json(), overwrite
        self.stream, self.batch = options.get("stream"), int(options.get("batch", -1))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        return _write_parts(self.path, iterator)

    def commit(self, messages: list[Parts | None]) -> None:
        now = manifest(self.path)
        if self.stream is not None:
            if self.batch <= now["streams"].get(self.stream, -1):
                _delete(self.path, _files(messages))
                return
            now["streams"][self.stream] = self.batch
        now["schema"] = json.loads(self.schema)
        now["files"] = ([] if self.overwrite else now["files"]) + _files(messages)
        _replace(self.path, now)

    def abort(self, messages: list[Parts | None]) -> None:
        _delete(self.path, _files(messages))


class StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.schema, self.stream = options["path"], schema.json(), options.get("stream", options.get("checkpointlocation", "stream"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        return _write_parts(self.path, iterator)

    def commit(self, messages: list[Parts | None], batchId: int) -> None:
        now = manifest(self.path)
        if batchId <= now["streams"].get(self.stream, -1):
            _delete(self.path, _files(messages))
            return
        now["streams"][self.stream] = batchId
        now["schema"] = json.loads(self.schema)
        now["files"] += _files(messages)
        _replace(self.path, now)

    def abort(self, messages: list[Parts | None], batchId: int) -> None:
        _delete(self.path, _files(messages))


class Committed(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise ValueError("read a committed table with cadence.sources.committed.read")

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(dict(self.options), schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Committed)


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows that count, through Spark's own Parquet scan. `schema` is that of a table which nothing was written to."""
    now = manifest(path)
    known = StructType.fromJson(now["schema"]) if now["schema"] else StructType.fromDDL(schema) if schema else None
    if known is None:
        raise ValueError(f"no table and no schema: {path}")
    return spark.read.schema(known).parquet(*[f"{path}/{f}" for f in now["files"]]) if now["files"] else spark.createDataFrame([], known)


def write(df: DataFrame, path: str, overwrite: bool = False, stream: str | None = None, batch: int | None = None) -> None:
    """Append or replace in one step; with `stream` and `batch` at most once for that batch of that stream."""
    register(df.sparkSession)
    if stream is not None and batch <= manifest(path)["streams"].get(stream, -1):
        return
    writer = df.write.format(NAME).mode("overwrite" if overwrite else "append")
    for key, value in (("stream", stream), ("batch", batch)):
        writer = writer if value is None else writer.option(key, value)
    writer.save(path)


def upsert(new: DataFrame, retried: DataFrame, path: str, key: str, stream: str | None = None, batch: int | None = None) -> None:
    """Rows of retried keys go and the new rows come, in one step."""
    old = read(new.sparkSession, path, new.schema.simpleString().removeprefix("struct<").removesuffix(">"))
    write(old.join(retried.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new), path, True, stream, batch)


def append_stream(df: DataFrame, path: str, checkpoint: str, stream: str | None = None, trigger: dict | None = None):
    """A stream appended to a table, each batch once. Returns the query."""
    register(df.sparkSession)
    writer = df.writeStream.format(NAME).option("checkpointLocation", checkpoint).option("stream", stream or checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"availableNow": True})).start(path)


def keep_newest(df: DataFrame, path: str, checkpoint: str, time: str, keep: int = 200, ties: list[str] | None = None, trigger: dict | None = None):
    """A stream of which the table holds the newest rows, `keep` of them at most: each batch is cut to its own newest first,
    so what is stored, joined and written is bounded however long the stream runs. Returns the query."""

    def merge(batch: DataFrame, number: int) -> None:
        old = read(batch.sparkSession, path, batch.schema.simpleString().removeprefix("struct<").removesuffix(">"))
        best = newest(newest(batch, time, keep, ties).unionByName(old.select(*batch.columns)), time, keep, ties)
        write(best.coalesce(1), path, True, checkpoint, number)

    return df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def sweep(path: str) -> int:
    """Deletes part files that no manifest names, left by killed drivers or replaced; only while no one reads or writes the
    table. Returns how many."""
    system, root = opened(path)
    named = set(manifest(path)["files"])
    found = [f"data/{f.base_name}" for f in system.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True)) if f.type == fs.FileType.File]
    _delete(path, [f for f in found if f not in named])
    return len([f for f in found if f not in named])
