"""Evaluate counters on labelled recordings: join, replay, match, score, summarise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.functions.scalars import int_list, int_or_null, task_of
from cadence.kernels.counters import REGISTRY, counter
from cadence.operators.labels import greedy_matches
from cadence.operators.metrics import count_metrics, pooled
from cadence.operators.replay import replay

TOLERANCE_MS = 1000


def guard(name: str, split: str, final: bool = False, grid: bool = False) -> None:
    """The test split needs `final`; parameter grids run on val only."""
    if name not in REGISTRY:
        raise ValueError(f"no counter {name!r}")
    if split == "test" and not final:
        raise ValueError("the test split is for the final evaluation only")
    if grid and split != "val":
        raise ValueError("parameters are tuned on val only")


def labels_of_split(labels: DataFrame, assignment: DataFrame, split: str) -> DataFrame:
    """Rep labels with a count of one split."""
    ids = assignment.where(F.col("split") == split).select("video_id")
    return labels.where((task_of(F.col("label")) == "reps") & int_or_null(F.col("rep_count")).isNotNull()).join(ids, "video_id", "left_semi")


def missing_frames(labels: DataFrame, frames: DataFrame) -> DataFrame:
    """Labelled videos without frames: reported, never skipped in silence."""
    return labels.select("video_id").join(frames.select("video_id"), "video_id", "left_anti").orderBy("video_id")


def count_reps(frames: DataFrame, name: str, **options) -> DataFrame:
    """(video_id, rep_times): what a counter counts in each video."""
    kernel = counter(name, **options)
    rows = replay(frames, ["video_id"], ["ts_ms", "frame_idx"], kernel)
    when = rows.where("counted").select("video_id", F.col("tick_ms").alias("t")) if "counted" in rows.columns else rows.select("video_id", F.col("rep_ms").alias("t"))
    found = when.groupBy("video_id").agg(F.array_sort(F.collect_list("t")).alias("rep_times"))
    return frames.select("video_id").distinct().join(found, "video_id", "left").select("video_id", F.coalesce("rep_times", F.array().cast("array<double>")).alias("rep_times"))


def score(frames: DataFrame, labels: DataFrame, name: str, tolerance_ms: float = TOLERANCE_MS, **options) -> DataFrame:
    """One scored row per labelled video with frames; not applicable (status 'n/a', no metrics) where the counter does not
    support the label."""
    supports = REGISTRY[name][1]

    @F.pandas_udf("boolean")
    def supported(label: pd.Series) -> pd.Series:
        return label.map({v: bool(supports(v)) for v in label.dropna().unique()}).fillna(False).astype(bool)

    able = supported(F.col("label"))
    counted = count_reps(frames.drop("label").join(labels.where(able).select("video_id"), "video_id", "left_semi"), name, **options)
    truth = labels.select("video_id", "label", (F.col("is_ambiguous") == "true").alias("ambiguous"), int_list(F.col("rep_timestamps_ms")).alias("truth_ms"), able.alias("able"))
    present = frames.select("video_id").distinct()
    rows = truth.join(present, "video_id", "left_semi").join(counted, "video_id", "left")
    pairs = greedy_matches(F.col("rep_times"), F.col("truth_ms"), tolerance_ms)
    late = F.transform("m", lambda x: F.get("rep_times", x["j"]) - F.get("truth_ms", x["i"]))
    sized = rows.withColumn("m", F.when(F.col("able"), pairs)).withColumns({"status": F.when(F.col("able"), "ok").otherwise("n/a"), "predicted": F.when(F.col("able"), F.size("rep_times")), "truth": F.size("truth_ms"), "matched": F.when(F.col("able"), F.size("m")), "latency_ms": F.try_divide(F.aggregate(late, F.lit(0.0), lambda s, v: s + v), F.nullif(F.size("m"), F.lit(0)))})
    return count_metrics(sized.drop("m", "able", "rep_times", "truth_ms"))


def summary(scored: DataFrame) -> DataFrame:
    """Per label and in total over the rows that apply, with and without ambiguous ones."""
    return pooled(scored.where("status = 'ok'"), "label", F.col("ambiguous"))


def grid_ranking(frames: DataFrame, labels: DataFrame, name: str, grid: list[dict]) -> DataFrame:
    """(params, mae, obo) of each parameter set, best first; the sets are few by their nature."""
    out = None
    for k, options in enumerate(grid):
        rows = score(frames, labels, name, **options).where("status = 'ok'").select(F.lit(k).alias("params"), "abs_error", "off_by_one")
        out = rows if out is None else out.unionByName(rows)
    from cadence.operators.metrics import rank_parameters

    return rank_parameters(out)
