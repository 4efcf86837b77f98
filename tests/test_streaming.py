"""A kernel over a stream gives what it gives over the table."""

import pytest
from pyspark.sql import functions as F

from cadence.kernels.counters import SignalCounter, ThresholdCounter
from cadence.kernels.states import HoldTimer
from cadence.kernels.windows import WindowStream
from cadence.operators.replay import replay
from cadence.sources.tables import POSE, synthetic_movement, synthetic_poses
from cadence.streaming import runner


def pour(spark, tmp_path, df, kernel, names, parts=4):
    """Write a table as several files in order of time, with a last row per key far ahead to push the watermark."""
    table = df.withColumn("at", (F.col("ts_ms") / 1000 + 1_700_000_000).cast("timestamp"))
    top = table.agg(F.max("ts_ms")).first()[0]
    folder = tmp_path / "in"
    for k in range(parts):
        low, high = top * k / parts, top * (k + 1) / parts
        cut = (F.col("ts_ms") >= low) & ((F.col("ts_ms") < high) | (F.lit(k == parts - 1) & (F.col("ts_ms") <= high)))
        table.where(cut).orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(str(folder))
    for k in (1, 2):
        late = spark.createDataFrame([(-k, 10**7 * k)], "stream_id long, ts_ms long")
        filler = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name not in ("stream_id", "ts_ms", "at")]
        late.select("*", *filler).withColumn("at", (F.col("ts_ms") / 1000 + 1_700_000_000).cast("timestamp")).select(*table.columns).coalesce(1).write.mode("append").parquet(str(folder))
    stream = runner.event_stream(spark, str(folder), table.schema)
    out = runner.run(stream, ["stream_id"], "at", kernel, names=names, idle_ms=5000)
    name = f"out{abs(hash(str(tmp_path)))}"
    query = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return [r for r in spark.table(name).collect() if r.stream_id >= 0]


@pytest.mark.parametrize("kernel", [SignalCounter(), ThresholdCounter(0.1, 0.4, 0.2)])
def test_values(spark, tmp_path, kernel):
    df = synthetic_movement(spark, 3, reps=4, fps=15, noise=0.01).select("stream_id", "ts_ms", "value")
    want = replay(df, ["stream_id"], ["ts_ms"], kernel).collect()
    got = pour(spark, tmp_path, df, kernel, None)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and len(want) >= 12


def test_holds(spark, tmp_path):
    df = synthetic_movement(spark, 2, reps=3, fps=15).select("stream_id", "ts_ms", (F.col("value") > 0.2).alias("ok"))
    want = replay(df, ["stream_id"], ["ts_ms"], HoldTimer()).collect()
    assert sorted(map(tuple, pour(spark, tmp_path, df, HoldTimer(), None, 3)), key=str) == sorted(map(tuple, want), key=str)


def test_windows_flush(spark, tmp_path):
    import numpy as np

    t = np.arange(0, 7000, 33)
    rows = [(0, int(a), [None if q is None else tuple(q.values()) for q in p], 640, 480) for a, p in zip(t, synthetic_poses((1 - np.cos(t / 400)) / 2), strict=True)]
    df = spark.createDataFrame(rows, f"stream_id long, ts_ms long, pose {POSE}, width int, height int")
    want = replay(df, ["stream_id"], ["ts_ms"], WindowStream()).collect()
    got = pour(spark, tmp_path, df, WindowStream(), None, 3)
    assert sorted((r.start, r.missing_ratio, str(r.rows)) for r in got) == sorted((r.start, r.missing_ratio, str(r.rows)) for r in want) and len(want) >= 5


def test_repeats_are_dropped(spark, tmp_path):
    df = synthetic_movement(spark, 1, reps=1, fps=5).withColumn("at", (F.col("ts_ms") / 1000 + 1_700_000_000).cast("timestamp"))
    df.unionByName(df).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = runner.once(runner.event_stream(spark, str(tmp_path / "in"), df.schema), ["stream_id"], "at")
    q = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == df.count()


def test_history_is_appended_to(spark, tmp_path):
    from cadence.sources.sinks import append_history, newest

    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "history", "check"))
    for k in range(3):
        spark.createDataFrame([(10 * k + i, i) for i in range(4)], "ended_ms long, reps int").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("ended_ms long, reps int").parquet(source)
        append_history(stream, path, checkpoint).awaitTermination(120)
        assert spark.read.parquet(path).count() == 4 * (k + 1)
    assert [r.ended_ms for r in newest(spark.read.parquet(path), "ended_ms", 5).collect()] == [13, 20, 21, 22, 23]
