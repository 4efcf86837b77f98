"""From frames to feature rows, windows and window datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.kernels.windows import MISSING, FeatureStream, WindowStream
from cadence.operators.replay import replay

KEYS, ORDER = ["video_id"], ["ts_ms", "frame_idx"]


def sequence_features(frames: DataFrame) -> DataFrame:
    """(video_id, k, missing, features): 47 features per tick at 15 a second, short gaps filled."""
    return replay(frames, KEYS, ORDER, FeatureStream())


def feature_windows(frames: DataFrame) -> DataFrame:
    """(video_id, start, missing_ratio, usable, rows) of every full window."""
    return replay(frames, KEYS, ORDER, WindowStream())


def vocabulary(videos: DataFrame) -> DataFrame:
    """(label, y): labels numbered in order."""
    labels = videos.agg(F.array_sort(F.collect_set("label")).alias("l"))
    return labels.select(F.posexplode("l").alias("y", "label")).select("label", "y")


def window_dataset(frames: DataFrame, assignment: DataFrame) -> DataFrame:
    """(split, video_id, label, y, start, rows): usable windows of the videos of a split document."""
    videos = frames.select("video_id", "label").distinct().join(assignment.select("video_id", "split"), "video_id")
    rows = feature_windows(frames.join(assignment.select("video_id"), "video_id", "left_semi")).where("usable")
    named = videos.join(vocabulary(videos), "label")
    return rows.join(named, "video_id").select("split", "video_id", "label", "y", "start", "rows")


def window_counts(frames: DataFrame, assignment: DataFrame, most: float = MISSING) -> DataFrame:
    """(split, kept, dropped): windows that can be used, and those with too much missing."""
    w = feature_windows(frames).join(assignment.select("video_id", "split"), "video_id")
    return w.groupBy("split").agg(F.count_if(F.col("missing_ratio") <= most).alias("kept"), F.count_if(F.col("missing_ratio") > most).alias("dropped"))
