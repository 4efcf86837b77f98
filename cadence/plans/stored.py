"""Queries that go through storage and streams: archives, committed tables, and kernels over streams with typed state.

What they write lies in the shared checkpoint folder. Streams read the tables as files, to the end, with a far-off last row
that lets the watermark pass all others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.kernels.base import Kernel
from cadence.kernels.states import HoldTimer, SessionKernel
from cadence.kernels.windows import WindowStream
from cadence.plans.poses import _sequence, frames
from cadence.plans.registry import EVENTS, ORACLES, events, query, table
from cadence.session import ensure_checkpoint_dir
from cadence.sources import archives, committed
from cadence.streaming import keyed

FAR_MS = 9 * 10**12


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""WITH f AS (SELECT 'c' || label AS label, 'v' || (vec_id % 16) AS video_id, vec_id, CAST(0.5 + CAST(embedding[1] AS DOUBLE) / 2 AS FLOAT) AS x, vec_id % 5 = 0 AS gone FROM embeddings)
SELECT label, video_id, count(*) AS frames, count(*) FILTER (NOT gone) AS with_pose, min(vec_id) * 10 AS first_ms, max(vec_id) * 10 AS last_ms, round(sum(CASE WHEN NOT gone THEN CAST(x AS DOUBLE) END), 3) AS nose_x FROM f GROUP BY label, video_id""")
def archived_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings written as keypoint archives, one a video, and read again in slices."""
    f = frames(spark, sf_dir)
    own = f.select(F.concat(F.lit("v"), F.col("vec_id") % 16).alias("video_id"), F.concat(F.lit("c"), "group").alias("label"), F.floor(F.col("vec_id") / 16).cast("int").alias("frame_idx"), (F.col("vec_id") * 10).alias("ts_ms"), "width", "height", F.when(F.col("vec_id") % 5 != 0, F.col("pose")).alias("pose"))
    folder = _folder(spark, "archives")
    archives.write_archives(own, folder)
    back = archives.read_archives(spark, folder, ["video_id", "label", "ts_ms", "pose"], slice_bytes=1 << 16)
    nose = F.get("pose", F.lit(0))["x"]
    return back.groupBy("label", "video_id").agg(F.count("*").alias("frames"), F.count("pose").alias("with_pose"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.round(F.sum(nose), 3).alias("nose_x"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'second' ELSE 'first' END AS run, CASE WHEN doc_id % 3 = 1 THEN n_chars ELSE -n_chars END AS size FROM documents WHERE doc_id % 3 <> 2 OR doc_id % 2 = 1")
def committed_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of failures in a committed table after a second run: two kinds of rows are retried, one of them fails again,
    and the run's batch comes twice."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    folder = _folder(spark, "errors")
    committed.write(d.select("doc_id", F.lit("first").alias("run"), (-F.col("n_chars")).alias("size")), folder)
    again = d.where("doc_id % 3 = 1").select("doc_id", F.lit("second").alias("run"), F.col("n_chars").alias("size"))
    for _ in range(2):
        committed.upsert(again, d.where("doc_id % 3 = 1 or (doc_id % 3 = 2 and doc_id % 2 = 0)"), folder, "doc_id", "runs", 1)
    return committed.read(spark, folder)


@query("SELECT event_id, user_id, epoch_us(ts) // 1000 AS t FROM events ORDER BY t DESC, event_id LIMIT 200")
def streamed_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 events, kept by a stream as it appends."""
    source, folder = _folder(spark, "events"), _folder(spark, "newest")
    e = events(spark, sf_dir).select("event_id", "user_id", "t")
    e.repartition(3, F.xxhash64("event_id")).write.parquet(source)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(source)
    committed.keep_newest(stream, folder, f"{folder}-checkpoint", "t", 200, ["event_id"]).awaitTermination()
    return committed.read(spark, folder)


def _through_stream(rows: DataFrame, key: str, ts_ms: str, kernel: Kernel, order: list[str], names: dict[str, str] | None = None, idle_ms: int = 3_600_000) -> DataFrame:
    """The kernel's rows of a table that is poured through a stream, flushed at its end."""
    spark = rows.sparkSession
    folder = _folder(spark, "stream")
    # The stored times may be small numbers; the epoch itself would count as late.
    timed = rows.withColumn("at", F.timestamp_millis(F.col(ts_ms).cast("long") + 1))
    last = spark.range(1).select(*[(F.lit(-1).cast(f.dataType) if f.name == key else F.lit(FAR_MS).cast(f.dataType) if f.name == ts_ms else F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema])
    last = last.withColumn("at", F.timestamp_millis(F.lit(FAR_MS)))
    timed.unionByName(last).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(timed.schema).parquet(f"{folder}/in")
    out = keyed.run(stream, [key], "at", kernel, order, idle_ms=idle_ms, names=names, bucket_ms=max(10_000, idle_ms))
    q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").where(F.col(key) >= 0)


@query(ORACLES["pose_windows"])
def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the recordings from a stream, the last ones flushed by a timer."""
    out = _through_stream(_sequence(spark, sf_dir), "group", "ts_ms", WindowStream(), ["ts_ms", "vec_id"], idle_ms=60_000)
    at = lambda k: F.round(F.get(F.get("rows", F.lit(k)), F.lit(0)), 5)
    return out.select("group", "start", "missing_ratio", "usable", F.size("rows").alias("length"), at(0).alias("first"), at(29).alias("last"))


@query(ORACLES["hold_timer_replay"])
def streamed_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("ok", F.col("value") > 50)
    out = _through_stream(e, "user_id", "t", HoldTimer(43_200_000, 3_600_000), ["t", "event_id"], {"ts_ms": "t"})
    return out.where("ended_ms is not null").select("user_id", F.col("ended_ms").alias("duration_ms"))


#: The session machine row by row: a set is open or not, and closes at the first row more than 12 hours after a moving one.
_SESSIONS = f"""WITH RECURSIVE {EVENTS}, s AS (SELECT user_id, t, value > 30 AS moving, value > 90 AS warning, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS INT) AS reps, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
r AS (SELECT user_id, n, t, true AS open, t AS start_ms, reps, CASE WHEN reps > 0 AND warning THEN 1 ELSE 0 END AS warned, reps = 0 AND warning AS soon, t AS active, false AS closed FROM s WHERE n = 1
  UNION ALL SELECT user_id, n, t, CASE WHEN was THEN t - now <= 43200000 ELSE moving END, CASE WHEN NOT was AND moving THEN t ELSE start_ms END, CASE WHEN was THEN greatest(reps, had) WHEN moving THEN 0 ELSE had END,
    CASE WHEN was THEN warned + CASE WHEN reps > had AND (soon OR warning) THEN 1 ELSE 0 END WHEN moving THEN 0 ELSE warned END, CASE WHEN was THEN reps <= had AND (soon OR warning) WHEN moving THEN false ELSE soon END, now, was AND t - now > 43200000
  FROM (SELECT s.user_id, s.n, s.t, s.moving, s.warning, s.reps, r.reps AS had, r.open AS was, r.start_ms, r.warned, r.soon, CASE WHEN s.moving THEN s.t ELSE r.active END AS now FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1) z)
SELECT user_id, CAST(NULL AS VARCHAR) AS label, false AS manual, reps, warned AS reps_with_warning, CAST(0 AS DOUBLE) AS hold_ms, CAST(start_ms AS DOUBLE) AS start_ms, CAST(t AS DOUBLE) AS end_ms, CAST(t - start_ms AS DOUBLE) AS duration_ms FROM r WHERE closed AND reps > 0"""
ORACLES["session_machine"] = _SESSIONS


@query(_SESSIONS)
def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session machine of `session_machine` over a stream."""
    none = lambda t: F.lit(None).cast(t)
    upto = Window.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = events(spark, sf_dir).withColumns({"kind": none("string"), "label": none("string"), "confidence": none("double"), "uncertain": none("boolean"), "moving": F.col("value") > 30, "reps": F.sum((F.col("event_type") == "purchase").cast("int")).over(upto), "hold_ms": F.lit(0.0), "holding": F.lit(False), "warning": F.col("value") > 90})
    return _through_stream(e.drop("value", "event_type"), "user_id", "t", SessionKernel(rest_ms=43_200_000, started=True), ["t", "event_id"], {"ts_ms": "t"})
