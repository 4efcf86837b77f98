"""Row rules of label sheets, label editing, and agreement between labelling sessions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions.scalars import int_list, int_or_null, is_iso_time, ratio, rises, task_of
from cadence.kernels.edits import EditLog
from cadence.operators.replay import replay
from cadence.sources.tables import LABEL_COLUMNS

# Fixed values, in ms.
DURATION_SLACK, AGREEMENT, MARK_GAP = 250, 300, 150


def _blank(c: str) -> Column:
    return F.trim(F.col(c)) == ""


def _whole(c: str) -> Column:
    """Blank or an integer."""
    return _blank(c) | int_or_null(F.col(c)).isNotNull()


def label_problems(labels: DataFrame, manifest: DataFrame) -> DataFrame:
    """(video_id, problem): one row per broken rule, also for missing columns ('-') and repeated ids. Which rules hold for a
    row is decided by the task of the manifest's label; an id that the manifest lacks breaks that rule alone."""
    lacking = [c for c in LABEL_COLUMNS if c not in labels.columns]
    if lacking:
        return labels.sparkSession.createDataFrame([("-", f"missing columns: {', '.join(lacking)}")], "video_id string, problem string")
    known = manifest.select(F.col("video_id").alias("m_id"), F.col("label").alias("m_label"), (F.col("duration_s").cast("double") * 1000).alias("ms"))
    row = labels.join(known, F.col("video_id") == F.col("m_id"), "left")
    ambiguous = F.col("is_ambiguous") == "true"
    common = [
        F.when(F.col("label") != F.col("m_label"), "label differs from the manifest"),
        F.when(~F.col("is_ambiguous").isin("true", "false"), "is_ambiguous must be true or false"),
        F.when(ambiguous & _blank("notes"), "ambiguous without notes"),
        F.when(_blank("labeler"), "no labeler"),
        F.when(~is_iso_time(F.col("labeled_at")), "labeled_at is no ISO 8601 time"),
    ]
    count, marks = int_or_null(F.col("rep_count")), int_list(F.col("rep_timestamps_ms"))
    numbers = _whole("rep_count") & ~F.exists(marks, lambda v: v.isNull())
    n = F.size(marks)
    last = F.col("ms") + DURATION_SLACK
    reps = [
        F.when(~numbers, "rep_count or rep_timestamps_ms is no integer"),
        F.when(numbers & (count.isNull() | (count != n)), "rep_count differs from the number of marks"),
        F.when(numbers & ~rises(marks), "marks do not rise"),
        F.when(numbers & (n > 0) & ((F.get(marks, F.lit(0)) < 0) | (F.element_at(marks, F.when(n > 0, n).otherwise(1)) > last)), "mark outside the video"),
        F.when(numbers & ~(_blank("hold_start_ms") & _blank("hold_end_ms")), "hold fields of a rep exercise"),
        F.when(numbers & (count == 0) & ~ambiguous, "0 reps without ambiguity"),
    ]
    start, end = int_or_null(F.col("hold_start_ms")), int_or_null(F.col("hold_end_ms"))
    whole = _whole("hold_start_ms") & _whole("hold_end_ms")
    holds = [
        F.when(~(_blank("rep_count") & _blank("rep_timestamps_ms")), "rep fields of a hold exercise"),
        F.when(~whole, "hold_start_ms or hold_end_ms is no integer"),
        F.when(whole & (start.isNull() | end.isNull()) & ~ambiguous, "hold_start_ms and hold_end_ms are required"),
        F.when(whole & ~((start >= 0) & (start < end) & (end <= last)), "hold outside the video"),
    ]
    by_task = F.when(task_of(F.col("m_label")) == "hold", F.array(*holds)).otherwise(F.array(*reps))
    found = F.when(F.col("m_id").isNull(), F.array(F.lit("video_id is not in the manifest"))).otherwise(F.array_compact(F.concat(F.array(*common), by_task)))
    broken = row.select("video_id", F.explode(found).alias("problem"))
    twice = labels.groupBy("video_id").count().where("count > 1").select("video_id", F.lit("video_id occurs more than once").alias("problem"))
    return twice.unionByName(broken)


def class_summary(labels: DataFrame) -> DataFrame:
    """(label, n_videos, n_ambiguous, unit, mean, min, max): marks of rep exercises, seconds of holds."""
    hold = task_of(F.col("label")) == "hold"
    seconds = (int_or_null(F.col("hold_end_ms")) - int_or_null(F.col("hold_start_ms"))) / 1000
    value = F.when(hold, seconds).otherwise(F.size(int_list(F.col("rep_timestamps_ms"))).cast("double"))
    rows = labels.select("label", (F.col("is_ambiguous") == "true").alias("a"), F.when(hold, "hold seconds").otherwise("reps").alias("unit"), value.alias("v"))
    return rows.groupBy("label", "unit").agg(F.count("*").alias("n_videos"), F.count_if("a").alias("n_ambiguous"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))


def unlabelled(labels: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.select("video_id").distinct().join(labels.select("video_id"), "video_id", "left_anti").orderBy("video_id")


def closest_pairs(predicted: np.ndarray, truth: np.ndarray, tolerance: float) -> list[dict]:
    """Matches of two ascending series, closest pairs first: only pairs within the tolerance are looked at."""
    low, high = np.searchsorted(predicted, truth - tolerance, "left"), np.searchsorted(predicted, truth + tolerance, "right")
    i = np.repeat(np.arange(len(truth)), high - low)
    j = np.arange(len(i)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
    d = np.abs(predicted[j] - truth[i])
    free_i, free_j, out = np.ones(len(truth), bool), np.ones(len(predicted), bool), []
    for k in np.lexsort((j, i, d)):
        if free_i[i[k]] and free_j[j[k]]:
            free_i[i[k]] = free_j[j[k]] = False
            out.append({"d": int(d[k]), "i": int(i[k]), "j": int(j[k])})
    return out


def greedy_matches(predicted: Column, truth: Column, tolerance: float) -> Column:
    """One-to-one matches of two ascending arrays, closest pairs first (ties: earlier truth, then earlier prediction)."""

    @F.pandas_udf("array<struct<d:bigint,i:int,j:int>>")
    def match(p: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else closest_pairs(np.asarray(a, float), np.asarray(b, float), tolerance) for a, b in zip(p, t, strict=True)], dtype=object)

    return match(predicted, truth)


def pointer_matches(first: Column, second: Column, tolerance: float = AGREEMENT) -> Column:
    """How many marks pair up walking both ascending arrays at once. A fold over all steps of the walk."""
    steps = F.sequence(F.lit(0), F.size(first) + F.size(second))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("n"))

    def step(acc: Column, _: Column) -> Column:
        a, b = F.get(first, acc["i"]), F.get(second, acc["j"])
        meet = F.abs(a - b) <= tolerance
        go = a.isNotNull() & b.isNotNull()
        one = lambda c: F.when(go & c, 1).otherwise(0)
        return F.struct((acc["i"] + one(meet | (a < b))).alias("i"), (acc["j"] + one(meet | ~(a < b))).alias("j"), (acc["n"] + one(meet)).alias("n"))

    return F.aggregate(steps, start, step, lambda a: a["n"])


def agreement_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """(video_id, first, second, difference, timing_match) of rep videos in both sessions."""
    a = first.where(task_of(F.col("label")) == "reps").select("video_id", int_list(F.col("rep_timestamps_ms")).alias("a"))
    both = a.join(second.select("video_id", int_list(F.col("rep_timestamps_ms")).alias("b")), "video_id")
    most = F.greatest(F.size("a"), F.size("b"), F.lit(1))
    return both.select("video_id", F.size("a").alias("first"), F.size("b").alias("second"), (F.size("b") - F.size("a")).alias("difference"), (pointer_matches(F.col("a"), F.col("b")) / most).alias("timing_match"))


def agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """(n_videos, exact, off_by_one, mae, timing_match) over both sessions."""
    d = F.abs("difference")
    return agreement_rows(first, second).agg(F.count("*").alias("n_videos"), F.avg((d == 0).cast("double")).alias("exact"), F.avg((d <= 1).cast("double")).alias("off_by_one"), F.avg(d).alias("mae"), F.avg("timing_match").alias("timing_match"))


def replay_edits(events: DataFrame, key: str = "video_id", order: str = "seq") -> DataFrame:
    """(key, marks, hold_start_ms, hold_end_ms, is_ambiguous, notes, status) from an edit log of kinds add (`at_ms`),
    undo, hold_start, hold_end, clear_hold, ambiguous (`flag`, `text`). A mark closer than 150 ms to another is refused, as
    is one without a time. Events of the same `order` go by kind, time, flag and text. A log streams through its task: memory
    is the marks that stand."""
    log = events.select(key, order, "kind", F.col("at_ms").cast("bigint").alias("at_ms"), "flag", "text")
    out = replay(log, [key], [order, "kind", "at_ms", "flag", "text"], EditLog(MARK_GAP))
    done = (F.size("marks") > 0) | (F.col("hold_start_ms").isNotNull() & F.col("hold_end_ms").isNotNull())
    return out.withColumn("status", F.when(F.col("is_ambiguous"), "ambiguous").when(done, "done").otherwise("todo"))


def export_problems(edited: DataFrame, manifest: DataFrame) -> DataFrame:
    """(video_id, problem) of edited labels before they are exported."""
    row = edited.join(manifest.select("video_id", (F.col("duration_s") * 1000).alias("ms"), task_of(F.col("label")).alias("task")), "video_id")
    last = F.col("ms") + DURATION_SLACK
    problems = F.array_compact(F.array(
        F.when(F.col("is_ambiguous") & _blank("notes"), "ambiguous without notes"),
        F.when((F.col("task") == "reps") & (F.size("marks") == 0) & ~F.col("is_ambiguous"), "no marks"),
        F.when(F.exists("marks", lambda m: (m < 0) | (m > last)), "mark outside the video"),
        F.when((F.col("task") == "hold") & (F.col("hold_start_ms").isNull() | F.col("hold_end_ms").isNull()) & ~F.col("is_ambiguous"), "hold is open"),
        F.when(F.col("hold_start_ms") >= F.col("hold_end_ms"), "hold ends before it starts"),
    ))
    return row.select("video_id", F.explode(problems).alias("problem"))


def to_sheet(edited: DataFrame, labels: DataFrame, labeler: str, labeled_at: Column) -> DataFrame:
    """Edited labels as rows of a label sheet, all text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = edited.join(labels.select("video_id", "label"), "video_id").withColumn("task", task_of(F.col("label")))
    reps = F.col("task") == "reps"
    return row.select("video_id", "label", F.when(reps, F.size("marks").cast("string")).otherwise("").alias("rep_count"), F.when(reps, F.array_join("marks", ";")).otherwise("").alias("rep_timestamps_ms"), text("hold_start_ms").alias("hold_start_ms"), text("hold_end_ms").alias("hold_end_ms"), F.col("is_ambiguous").cast("string").alias("is_ambiguous"), "notes", F.lit(labeler).alias("labeler"), labeled_at.alias("labeled_at"))


def from_sheet(sheet: DataFrame) -> DataFrame:
    return sheet.select("video_id", "label", int_list(F.col("rep_timestamps_ms")).alias("marks"), int_or_null(F.col("hold_start_ms")).alias("hold_start_ms"), int_or_null(F.col("hold_end_ms")).alias("hold_end_ms"), (F.col("is_ambiguous") == "true").alias("is_ambiguous"), "notes")


def merge_labels(old: DataFrame, imported: DataFrame, key: str = "video_id") -> DataFrame:
    """All rows, imported ones in place of old ones."""
    return old.join(imported.select(key), key, "left_anti").unionByName(imported)


def in_both(first: DataFrame, second: DataFrame, key: str = "video_id") -> DataFrame:
    """(key): keys of both sessions, each once."""
    return first.select(key).intersect(second.select(key))


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """All rows of parts with the same columns, one part after the other; repeated rows stay."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def count_share(df: DataFrame, by: str) -> DataFrame:
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    return n.join(n.agg(F.sum("n").alias("total")), F.lit(True)).select(by, "n", ratio(F.col("n"), F.col("total")).alias("share"))
