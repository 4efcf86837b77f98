"""Writers and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.geometry import no_pose
from cadence.functions.scalars import finite


def write_by_label(df: DataFrame, path: str, label: str = "label", mode: str = "overwrite") -> None:
    """Parquet in folders by label; rows of a label come together first, so no task writes into every folder. A job's
    output becomes visible as a whole or not at all."""
    df.repartition(label, F.pmod(F.xxhash64(*[c for c in df.columns if c != label][:1]), F.lit(16))).write.mode(mode).partitionBy(label).parquet(path)


def pending(manifest: DataFrame, done: DataFrame, key: str = "video_id", limit: int | None = None) -> DataFrame:
    """Rows without output yet."""
    left = manifest.join(done.select(key), key, "left_anti")
    return left if limit is None else left.orderBy(key).limit(limit)


def upsert_errors(old: DataFrame, retried: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """The error log after a run: rows of retried keys go, new failures come."""
    return old.join(retried.select(key).distinct(), key, "left_anti").unionByName(failed)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")


def quoted(text: Column) -> Column:
    """A CSV field, in quotes only if it needs them."""
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def fixed(value: Column, decimals: int) -> Column:
    """Fixed decimals, blank for missing."""
    return F.coalesce(F.format_string(f"%.{decimals}f", value.cast("double")), F.lit("")) if decimals else F.coalesce(value.cast("string"), F.lit(""))


def frame_json(pose: Column, decimals: int = 5) -> Column:
    """A frame as JSON numbers, null for missing ones; null for a frame without a pose."""
    number = lambda v: F.coalesce(F.round(finite(v), decimals).cast("string"), F.lit("null"))
    point = lambda p: F.concat(F.lit("["), F.concat_ws(",", number(p["x"]), number(p["y"]), number(p["z"]), number(p["visibility"])), F.lit("]"))
    return F.when(no_pose(pose), "null").otherwise(F.concat(F.lit("["), F.array_join(F.transform(pose, point), ","), F.lit("]")))


def video_json(frames: DataFrame) -> DataFrame:
    """(video_id, json): one document per video, frames in order of time."""
    rows = frames.groupBy("video_id", "label", "width", "height").agg(F.array_sort(F.collect_list(F.struct("ts_ms", "frame_idx", frame_json(F.col("pose")).alias("p")))).alias("f"))
    times = F.array_join(F.transform("f", lambda x: x["ts_ms"].cast("string")), ",")
    poses = F.array_join(F.transform("f", lambda x: x["p"]), ",")
    text = F.concat(F.lit('{"video_id":"'), "video_id", F.lit('","label":"'), "label", F.lit('","width":'), F.col("width").cast("string"), F.lit(',"height":'), F.col("height").cast("string"), F.lit(',"timestamps_ms":['), times, F.lit('],"landmarks":['), poses, F.lit("]}"))
    return rows.select("video_id", text.alias("json"))


def export_labelled(frames: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of labelled videos, and the labelled ids that have no frames."""
    wanted = labels.select("video_id").distinct()
    return video_json(frames.join(wanted, "video_id", "left_semi")), wanted.join(frames.select("video_id"), "video_id", "left_anti").orderBy("video_id")


def split_document(assignment: DataFrame, seed: int, version: str = "v1") -> DataFrame:
    """(json): ids by split, groups and counts per class as one sorted document."""
    ids = lambda s: F.array_sort(F.collect_list(F.when(F.col("split") == s, F.col("video_id"))))
    groups = F.map_from_entries(F.array_sort(F.collect_list(F.struct("video_id", "group_id"))))
    doc = assignment.agg(F.struct(*[ids(s).alias(s) for s in ("train", "val", "test")]).alias("splits"), groups.alias("groups"))
    return doc.select(F.to_json(F.struct(F.lit(version).alias("version"), F.lit(seed).alias("seed"), "splits", "groups")).alias("json"))


def newest(sets: DataFrame, time: str, keep: int = 200, ties: list[str] | None = None) -> DataFrame:
    """The newest rows, oldest first; of equally new ones the first in the order of `ties`."""
    rest = ties or []
    return sets.orderBy(F.desc(time), *rest).limit(keep).orderBy(F.col(time), *[F.desc(c) for c in rest])


def append_history(sets: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """A stream of closed sets appended to a stored history, each set once; `newest` reads the part to show. Returns the
    query."""
    writer = sets.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def trace_json(series: DataFrame, picks: DataFrame, key: str = "video_id", time: str = "ts_ms", value: str = "value", decimals: int = 3) -> DataFrame:
    """(key, json): one document of times and rounded values per picked series, in order of time."""
    rows = series.join(picks.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.round(F.col(value), decimals).alias("v")))).alias("s"))
    doc = F.struct(F.col(key), F.transform("s", lambda x: x["t"]).alias("t"), F.transform("s", lambda x: x["v"]).alias("v"))
    return rows.select(key, F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))


def labels_document(vocabulary: DataFrame, confidence: float, margin: float, length: int, stride: int) -> DataFrame:
    """(json): the labels of a model in order of their numbers, its thresholds and its window."""
    labels = vocabulary.agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "label"))), lambda x: x["label"]).alias("labels"))
    thresholds = F.struct(F.lit(confidence).alias("confidence"), F.lit(margin).alias("margin"))
    return labels.select(F.to_json(F.struct("labels", thresholds.alias("thresholds"), F.struct(F.lit(length).alias("length"), F.lit(stride).alias("stride")).alias("window"))).alias("json"))


def export_labels(entries: DataFrame, labels: DataFrame, index: str = "index") -> DataFrame:
    """Finished and ambiguous labels in the order of their entries."""
    return entries.select("video_id", index).join(labels.where(F.col("status").isin("done", "ambiguous")), "video_id").orderBy(index).drop(index)


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A report table of a result that is small by its nature; more than `most` rows are an error, not left out."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    show = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    head = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*head, *["| " + " | ".join(show(v) for v in r) + " |" for r in rows], ""])


def latest_by(df: DataFrame, key: str, time: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(time))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def speak_to(df: DataFrame, say):
    """A streaming sink: hand each micro-batch's rows, in order of time, to `say` on the driver. Returns the query."""
    return df.writeStream.foreachBatch(lambda batch, _: [say(r) for r in batch.orderBy("said_ms").toLocalIterator()]).start()
