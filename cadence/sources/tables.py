"""Readers: media folders, keypoint archives, split documents, label sheets, histories, synthetic series.

Every reader goes through Spark's own file sources, so paths may be of any file system that Spark knows.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.functions.scalars import file_stem, finite, snake_case

# File kinds of media folders, in order of preference, and the tables' columns.
MEDIA = ("mp4", "webm", "m4v", "mov", "avi", "mkv")
MANIFEST = "video_id string, label string, path string, ext string, fps double, n_frames int, duration_s double, width int, height int, size_bytes bigint, error string"
LABEL_COLUMNS = ("video_id", "label", "rep_count", "rep_timestamps_ms", "hold_start_ms", "hold_end_ms", "is_ambiguous", "notes", "labeler", "labeled_at")
POSE = "array<struct<x:double,y:double,z:double,visibility:double>>"
FRAMES = f"video_id string, label string, frame_idx int, ts_ms bigint, width int, height int, pose {POSE}"


def scan_media(spark: SparkSession, folder: str) -> DataFrame:
    """(video_id, label, path, ext, size_bytes) of `<class>/<file>`; the id is the normalised stem. File contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{%s}" % ",".join(MEDIA)).option("recursiveFileLookup", "true").load(folder).select("path", "length")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select(snake_case(file_stem(F.col("path"))).alias("video_id"), snake_case(F.regexp_extract("path", "([^/]*)/[^/]*$", 1)).alias("label"), "path", ext.alias("ext"), F.col("length").alias("size_bytes")).orderBy("label", "video_id", "path")


def pick_files(files: DataFrame) -> DataFrame:
    """One file per id where ids collide: the most preferred kind, then the smallest path."""
    rank = F.array_position(F.array(*[F.lit(m) for m in MEDIA]), F.col("ext"))
    best = Window.partitionBy("video_id").orderBy(F.when(rank == 0, len(MEDIA) + 1).otherwise(rank), "path")
    return files.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def probe(files: DataFrame, probe_one: Callable[[str], dict]) -> DataFrame:
    """The manifest: what `probe_one(path)` tells about each file (fps, n_frames, duration_s, width, height). A file that
    fails becomes a row with `error`, never a failed job."""
    names = ["fps", "n_frames", "duration_s", "width", "height"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path in frame["path"]:
                try:
                    found = probe_one(path)
                    rows.append([*[found.get(n) for n in names], found.get("error", "")])
                except Exception as e:  # noqa: BLE001  an unreadable file is a result here
                    rows.append([None] * len(names) + [f"{type(e).__name__}: {e}"])
            yield pd.concat([frame.reset_index(drop=True), pd.DataFrame(rows, columns=[*names, "error"])], axis=1)[[c.split()[0] for c in MANIFEST.split(", ")]]

    return files.mapInPandas(run, MANIFEST)


def conflicting_ids(manifest: DataFrame) -> DataFrame:
    """Ids that name more than one path."""
    return manifest.groupBy("video_id").agg(F.count_distinct("path").alias("paths")).where("paths > 1")


def keypoint_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of `.npz` archives `<label>/<video_id>.npz` (landmarks (T, 33, 4), timestamps_ms, width, height): one row per
    frame, NULL for what is missing and for frames without a pose."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(folder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with np.load(io.BytesIO(content)) as z:
                    marks, times, width, height = z["landmarks"].astype(float), z["timestamps_ms"], int(z["width"]), int(z["height"])
                    label = str(z["label"]) if "label" in z else path.split("/")[-2]
                video = path.rsplit("/", 1)[1].removesuffix(".npz")
                for start in range(0, len(marks), 2000):
                    part = marks[start : start + 2000]
                    poses = [None if not np.isfinite(p[:, :2]).any() else [dict(zip(("x", "y", "z", "visibility"), (None if not np.isfinite(v) else float(v) for v in q), strict=True)) for q in p] for p in part]
                    n = len(part)
                    yield pd.DataFrame({"video_id": [video] * n, "label": [label] * n, "frame_idx": range(start, start + n), "ts_ms": times[start : start + n], "width": [width] * n, "height": [height] * n, "pose": poses})

    return files.select("path", "content").mapInPandas(run, FRAMES)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, split) of a split document."""
    kinds = T.StructType([T.StructField(s, T.ArrayType(T.StringType())) for s in ("train", "val", "test")])
    doc = spark.read.schema(T.StructType([T.StructField("version", T.StringType()), T.StructField("splits", kinds)])).json(path, multiLine=True)
    each = F.array(*[F.struct(F.lit(s).alias("split"), F.col(f"splits.{s}").alias("ids")) for s in ("train", "val", "test")])
    return doc.select(F.explode(each).alias("s")).select("s.split", F.explode("s.ids").alias("video_id")).select("video_id", "split")


def read_sheet(spark: SparkSession, path: str, columns: tuple[str, ...] = LABEL_COLUMNS) -> DataFrame:
    """A CSV sheet in which all is text and a blank stays ''. Quotes, doubled quotes and line feeds in quotes are read;
    short rows are padded, blank lines skipped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    sheet = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", enforceSchema=True, nullValue="\u0000", emptyValue="")
    return sheet.select(*[F.coalesce(F.regexp_replace(c, "\r$", ""), F.lit("")).alias(c) for c in columns])


def read_detection(spark: SparkSession, path: str) -> DataFrame:
    """(label, n_frames, n_detected, detected_pct) per class and, with label NULL, in total, weighted by frames."""
    table = spark.read.schema("label string, n_frames bigint, n_detected bigint").csv(path, header=True)
    return detection_rollup(table)


def detection_rollup(table: DataFrame) -> DataFrame:
    sums = table.rollup("label").agg(F.sum("n_frames").alias("n_frames"), F.sum("n_detected").alias("n_detected"))
    return sums.withColumn("detected_pct", F.try_divide(F.lit(100.0) * F.col("n_detected"), F.col("n_frames")))


def parse_history(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Rows of a JSON array column; what is no array counts as empty."""
    items = F.from_json(F.col(text), f"array<{schema}>", {"mode": "PERMISSIVE"})
    return df.select(F.explode(F.coalesce(items, F.array().cast(f"array<{schema}>"))).alias("r")).select("r.*")


def landmarks_from_json(text, number_of: str = "array<array<double>>"):
    """Poses of a JSON frame: a missing number stays NULL, and a frame without a pose is NULL."""
    return F.transform(F.from_json(text, number_of), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"), F.get(p, F.lit(2)).alias("z"), F.get(p, F.lit(3)).alias("visibility")))


def clean_pose(pose):
    """NaN and infinities of a pose as NULL."""
    return F.transform(pose, lambda p: F.struct(*[finite(p[c]).alias(c) for c in ("x", "y", "z", "visibility")]))


def synthetic_movement(spark: SparkSession, streams: int, reps: int = 5, rep_s: float = 2.0, fps: float = 30.0, rest_s: float = 1.0, amplitude: float = 0.5, noise: float = 0.0, seed: int = 7) -> DataFrame:
    """(stream_id, frame_idx, ts_ms, value): a value that rests, swings out and back `reps` times on a raised cosine, and
    rests again. Made row by row from ranges, so any size is made in parallel."""
    total_s = 2 * rest_s + reps * rep_s
    n = int(total_s * fps)
    rows = spark.range(streams * n).select((F.col("id") / n).cast("long").alias("stream_id"), (F.col("id") % n).cast("int").alias("frame_idx"), F.col("id"))
    t = F.col("frame_idx") / fps
    phase = F.greatest(F.lit(0.0), F.least(t - rest_s, F.lit(reps * rep_s))) / rep_s
    jitter = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_003)) / 1_000_003 - 0.5) * 2 * noise
    return rows.select("stream_id", "frame_idx", F.floor(t * 1000 + 0.5).cast("long").alias("ts_ms"), (F.lit(amplitude) * (1 - F.cos(phase * 6.283185307179586)) / 2 + jitter).alias("value"))


# A standing body, (x, y) of the kept landmarks at rest and where the knees, hips and above go in a squat.
_STAND = {0: (0.5, 0.12), 11: (0.45, 0.25), 12: (0.55, 0.25), 13: (0.42, 0.38), 14: (0.58, 0.38), 15: (0.41, 0.5), 16: (0.59, 0.5), 23: (0.47, 0.52), 24: (0.53, 0.52), 25: (0.46, 0.7), 26: (0.54, 0.7), 27: (0.46, 0.9), 28: (0.54, 0.9)}
_SQUAT = {0: (0.02, 0.16), 11: (0.02, 0.17), 12: (0.02, 0.17), 13: (0.05, 0.14), 14: (0.05, 0.14), 15: (0.1, 0.08), 16: (0.1, 0.08), 23: (-0.05, 0.16), 24: (-0.05, 0.16), 25: (0.06, 0.02), 26: (0.06, 0.02)}
_CURL = {15: (0.03, -0.22), 16: (-0.03, -0.22)}


def synthetic_poses(depth: np.ndarray, kind: str = "squat", jitter: float = 0.0015, seed: int = 7) -> list:
    """One 33-landmark pose per depth (0 at rest, 1 all the way); landmarks that are not kept are missing."""
    rng = np.random.default_rng(seed)
    moves = _SQUAT if kind == "squat" else _CURL
    out = []
    for d in depth:
        if not np.isfinite(d):
            out.append(None)
            continue
        pose: list = [None] * 33
        for i, (x, y) in _STAND.items():
            dx, dy = moves.get(i, (0.0, 0.0))
            ex, ey = rng.standard_normal(2) * jitter
            pose[i] = {"x": float(x + d * dx + ex), "y": float(y + d * dy + ey), "z": 0.0, "visibility": 0.9}
        out.append(pose)
    return out
