"""Drive a kernel over a stream, key by key, with the same rows out as `cadence.operators.replay.replay` over a table.

Kernels need their rows in order of time, so rows wait in the state until the watermark has passed them; rows that come
later than that are dropped by the watermark, as Spark does everywhere. A key that has been silent for `idle_ms` of event
time is finished: what its kernel still holds is emitted and its state removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadence.kernels.base import Kernel
from cadence.streaming import keyed


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1, fmt: str = "parquet") -> DataFrame:
    """Files of a folder as a stream, a bounded number per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def once(df: DataFrame, keys: list[str], time: str, lateness: str = "10 seconds") -> DataFrame:
    """Rows of a stream without repeats of key and time; the state is bounded by the watermark."""
    return df.withWatermark(time, lateness).dropDuplicatesWithinWatermark([*keys, time])


def run(df: DataFrame, keys: list[str], time: str, kernel: Kernel, ts_ms: str = "ts_ms", lateness: str = "0 seconds", idle_ms: int = 60_000, names: dict[str, str] | None = None) -> DataFrame:
    """(keys, kernel.output) in append mode. `time` is a timestamp for the watermark, `ts_ms` the kernel's order."""
    return keyed.run(df, keys, time, kernel, [ts_ms], lateness, idle_ms, names)
