"""Pose quality of recordings: per video, per class, and what stands out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.geometry import any_visibility, fully_seen
from cadence.functions.scalars import dominant_side, finite, ratio
from cadence.kernels.forms import NAMED

# Joint groups by name, landmarks of either side, and the shares below which detection counts as low.
GROUPS = ("shoulder", "elbow", "wrist", "hip", "knee", "ankle")
LOW_CLASS, LOW_VIDEO = 0.80, 0.50


def _mean_visibility(pose: Column, marks: list[int]) -> Column:
    values = F.array(*[finite(F.get(pose, F.lit(i))["visibility"]) for i in marks])
    n = F.aggregate(values, F.lit(0), lambda s, v: s + v.isNotNull().cast("int"))
    return ratio(F.aggregate(values, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0))), F.nullif(n, F.lit(0)))


def detection_rate(frames: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, detected_pct): share of frames in which every x is there, in percent; 0 without frames."""
    return frames.groupBy(key).agg(F.coalesce(F.avg(fully_seen(F.col("pose")).cast("double")) * 100, F.lit(0.0)).alias("detected_pct"))


def video_quality(frames: DataFrame) -> DataFrame:
    """(video_id, label, duration_s, n_frames, n_detected, vis_<group>, side): visibilities are means over frames with a pose."""
    pose = F.col("pose")
    seen = any_visibility(pose)
    marks = {g: list(NAMED[g]) for g in GROUPS} | {s: [NAMED[g][k] for g in GROUPS] for k, s in enumerate(("left", "right"))}
    rows = frames.select("video_id", "label", "ts_ms", seen.alias("seen"), *[F.when(seen, _mean_visibility(pose, m)).alias(f"vis_{g}") for g, m in marks.items()])
    stats = rows.groupBy("video_id", "label").agg(((F.max("ts_ms") - F.min("ts_ms")) / 1000).alias("duration_s"), F.count("*").alias("n_frames"), F.count_if("seen").alias("n_detected"), *[F.avg(f"vis_{g}").alias(f"vis_{g}") for g in marks])
    return stats.withColumn("side", dominant_side(F.col("vis_left"), F.col("vis_right"))).drop("vis_left", "vis_right")


def side_summary(videos: DataFrame) -> DataFrame:
    """(label, side, share): the most frequent known side, ties by name; '-' where none is known."""
    n = videos.where("side <> 'unknown'").groupBy("label", "side").agg(F.count("*").alias("n"))
    w = Window.partitionBy("label")
    top = n.withColumns({"r": F.row_number().over(w.orderBy(F.desc("n"), "side")), "t": F.sum("n").over(w)}).where("r = 1").select("label", "side", ratio(F.col("n"), F.col("t")).alias("share"))
    return videos.select("label").distinct().join(top, "label", "left").select("label", F.coalesce("side", F.lit("-")).alias("side"), "share")


def by_class(videos: DataFrame) -> DataFrame:
    """Per label: sums, visibilities weighted by detected frames (a missing one counts 0), detected share, side; worst first."""
    vis = [f"vis_{g}" for g in GROUPS]
    weighted = [ratio(F.sum(F.coalesce(F.col(c) * F.col("n_detected"), F.lit(0.0))), F.nullif(F.sum("n_detected"), F.lit(0))).alias(c) for c in vis]
    table = videos.groupBy("label").agg(F.count("*").alias("n_videos"), F.sum("duration_s").alias("duration_s"), F.sum("n_frames").alias("n_frames"), F.sum("n_detected").alias("n_detected"), *weighted)
    table = table.withColumn("detected_pct", ratio(F.col("n_detected") * 100.0, F.col("n_frames")))
    return table.join(side_summary(videos), "label").orderBy("detected_pct", "label")


def findings(classes: DataFrame, videos: DataFrame) -> DataFrame:
    """(finding, value, detail): the overall share, the worst and best class, classes and videos below the limits, the least
    visible joint group and its three weakest classes, the shares of sides, and the videos without any pose."""
    text = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ", ")
    row = lambda df, name, value, detail: df.select(F.lit(name).alias("finding"), value.cast("double").alias("value"), detail.cast("string").alias("detail"))
    none = F.lit(None)
    overall = classes.agg(ratio(F.sum("n_detected") * 100.0, F.sum("n_frames")).alias("v"))
    worst = classes.orderBy("detected_pct", "label").limit(1)
    best = classes.orderBy(F.desc("detected_pct"), "label").limit(1)
    low = classes.where(F.col("detected_pct") < 100 * LOW_CLASS).agg(F.count("*").alias("v"), text("label").alias("d"))
    weak = videos.where(F.col("n_detected") < LOW_VIDEO * F.col("n_frames")).agg(F.count("*").alias("v"), text("video_id").alias("d"))
    groups = classes.select("label", F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.col(f"vis_{g}").alias("v")) for g in GROUPS])).alias("x")).select("label", "x.g", "x.v")
    joint = groups.groupBy("g").agg(F.avg("v").alias("v")).where("v is not null").orderBy("v", "g").limit(1)
    weakest = groups.join(joint.select("g"), "g").where("v is not null").orderBy("v", "label").limit(3).agg(F.count("*").alias("v"), text("label").alias("d"))
    sides = videos.groupBy("side").agg(F.count("*").alias("n")).withColumn("t", F.sum("n").over(Window.partitionBy(F.lit(1))))
    empty = videos.where("n_detected = 0").agg(F.count("*").alias("v"), text("video_id").alias("d"))
    parts = [row(overall, "detected_pct", F.col("v"), none), row(worst, "worst_class", F.col("detected_pct"), F.col("label")), row(best, "best_class", F.col("detected_pct"), F.col("label")), row(low, "low_classes", F.col("v"), F.col("d")), row(weak, "weak_videos", F.col("v"), F.col("d")), row(joint, "weakest_joint", F.col("v"), F.col("g")), row(weakest, "weakest_classes", F.col("v"), F.col("d")), row(sides, "side_share", ratio(F.col("n"), F.col("t")), F.col("side")), row(empty, "without_pose", F.col("v"), F.col("d"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def class_context(worst: DataFrame, detection: DataFrame) -> DataFrame:
    """(label, detected_pct, overall_pct, context): how the detection of poorly classified labels compares with the whole.
    detection: (label, detected_pct), the whole under label NULL."""
    whole = detection.where("label is null").select(F.col("detected_pct").alias("overall_pct"))
    joined = worst.join(detection.where("label is not null"), "label", "left").join(F.broadcast(whole.limit(1)), F.lit(True), "left")
    below = F.when(F.col("detected_pct").isNull(), "unknown").when(F.col("detected_pct") < F.col("overall_pct"), "below").otherwise("not below")
    return joined.select("label", "detected_pct", "overall_pct", below.alias("context"))
