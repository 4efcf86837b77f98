"""Series by key: resampling to a fixed grid, bounded gap filling, hopping row windows and their summaries.

All of it is window functions and groups over one partitioning by key, so a chain of these operators shuffles once. Frames
end at their row, so the work is linear in the rows of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def epoch_millis(ts: Column) -> Column:
    """Whole milliseconds, truncated from microseconds."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1000).cast("long")


#: Ticks of a key that one row gives at most.
TICKS = 1 << 16


def grid(df: DataFrame, key: str, time: str, step_ms: float) -> DataFrame:
    """(key, k, grid_ms): first time + k * step, as long as it does not pass the last time. Ticks are made from blocks of
    them, so no row grows with the span of a key."""
    ends = df.groupBy(key).agg(F.min(time).alias("t0"), F.max(time).alias("t1")).where("t0 is not null")
    step, size = F.lit(float(step_ms)), F.lit(TICKS).cast("long")
    blocks = ends.withColumn("last", F.floor((F.col("t1") - F.col("t0")) / step).cast("long")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), size)))
    ticks = blocks.select(key, "t0", F.explode(F.sequence("block", F.least(F.col("block") + size - 1, F.col("last")))).alias("k"))
    return ticks.select(key, F.col("k").cast("int").alias("k"), (F.col("t0") + F.col("k") * step).alias("grid_ms"))


def _latest(value: str | Column, key: str, order: list[Column]) -> Column:
    """The last value present up to each row. Looking ahead is the same in descending order: a frame that ends at the row
    is carried along, one that begins there would be read anew for every row."""
    past = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(past)


def _beside(df: DataFrame, key: str, time: str, values: list[str], step_ms: float) -> DataFrame:
    """Grid rows with the row before (`back`) and the row at or after (`ahead`) them. Grid rows sort before data at equal times."""
    data = df.where(F.col(time).isNotNull()).select(key, F.lit(None).cast("int").alias("k"), F.col(time).cast("double").alias("at"), F.lit(1).alias("kind"), F.struct(F.col(time).alias("t"), *values).alias("row"))
    ticks = grid(df, key, time, step_ms).select(key, "k", F.col("grid_ms").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(data.schema["row"].dataType).alias("row"))
    order = ["at", "kind", "k", "row.t", *[f"row.{v}" for v in values]]
    back = _latest("row", key, [F.col(c).asc() for c in order])
    ahead = _latest("row", key, [F.col(c).desc() for c in order])
    return data.unionByName(ticks).select(key, "k", "at", "kind", back.alias("back"), ahead.alias("ahead")).where("kind = 0")


def resample_nearest(df: DataFrame, key: str, time: str, values: list[str], step_ms: float, most_ms: float | None = None) -> DataFrame:
    """(key, k, grid_ms, source_ms, values): the row nearest to each tick, the earlier of two equally near ones.
    Values of rows more than `most_ms` away are NULL."""
    beside = _beside(df, key, time, values, step_ms)
    far = lambda row: F.abs(row["t"] - F.col("at"))
    lower, upper = F.coalesce("back", "ahead"), F.coalesce("ahead", "back")
    picked = beside.withColumn("row", F.when(far(lower) <= far(upper), lower).otherwise(upper))
    near = F.lit(True) if most_ms is None else far(F.col("row")) <= F.lit(float(most_ms))
    return picked.select(key, "k", F.col("at").alias("grid_ms"), F.col("row.t").alias("source_ms"), *[F.when(near, F.col(f"row.{v}")).alias(v) for v in values])


def sample_and_hold(df: DataFrame, key: str, time: str, values: list[str], step_ms: float, arrival: bool = False) -> DataFrame:
    """(key, k, grid_ms, source_ms, values): the latest row at or before each tick. With `arrival`, the row whose coming
    releases the tick, the first at or after it; rows without values are passed over by the one before them."""
    if not arrival:
        data = df.where(F.col(time).isNotNull()).select(key, F.lit(None).cast("int").alias("k"), F.col(time).cast("double").alias("at"), F.lit(0).alias("kind"), F.struct(F.col(time).alias("t"), *values).alias("row"))
        ticks = grid(df, key, time, step_ms).select(key, "k", F.col("grid_ms").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(data.schema["row"].dataType).alias("row"))
        order = Window.partitionBy(key).orderBy("at", "kind", "k", "row.t", *[F.col(f"row.{v}") for v in values]).rowsBetween(Window.unboundedPreceding, 0)
        held = data.unionByName(ticks).withColumn("row", F.last("row", ignorenulls=True).over(order)).where("kind = 1")
    else:
        held = _beside(df, key, time, values, step_ms).withColumn("row", F.coalesce("ahead", "back"))
    out = held.select(key, "k", F.col("at").alias("grid_ms"), F.col("row.t").alias("source_ms"), *[F.col(f"row.{v}").alias(v) for v in values])
    if arrival:
        past = Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({v: F.last(v, ignorenulls=True).over(past) for v in values})
    return out


def fill_gaps(df: DataFrame, key: str, index: str, values: list[str], most: int = 5) -> DataFrame:
    """Runs of at most `most` missing values between two present ones, filled on the straight line; nothing is extrapolated."""
    known = {v: F.when(F.col(v).isNotNull(), F.struct(F.col(index).alias("i"), F.col(v).cast("double").alias("v"))) for v in values}
    out = df.withColumns({f"_a_{v}": _latest(k, key, [F.col(index).asc()]) for v, k in known.items()} | {f"_b_{v}": _latest(k, key, [F.col(index).desc()]) for v, k in known.items()})
    for v in values:
        a, b = F.col(f"_a_{v}"), F.col(f"_b_{v}")
        slope = F.try_divide(b["v"] - a["v"], (b["i"] - a["i"]).cast("double"))
        line = F.when(b["i"] - a["i"] - 1 <= most, slope * (F.col(index) - a["i"]) + a["v"])
        out = out.withColumn(v, F.coalesce(F.col(v).cast("double"), line)).drop(f"_a_{v}", f"_b_{v}")
    return out


def window_starts(rows: Column, length: int, stride: int) -> Column:
    """0, stride, ... for full windows only; an empty array for shorter series."""
    return F.when(rows >= length, F.sequence(F.lit(0), (rows - length).cast("int"), F.lit(stride))).otherwise(F.array().cast("array<int>"))


def _in_windows(df: DataFrame, key: str, index: str, length: int, stride: int, columns: list[Column]) -> DataFrame:
    """Each row once per window that holds it, with the window's `start`: length / stride rows, not a frame per row. The
    windows of a key stay in its partition."""
    first, last = F.greatest(F.lit(0), F.ceil((F.col(index) - length + 1) / stride)), F.floor(F.col(index) / stride)
    starts = F.when(first <= last, F.sequence(first, last))
    return df.select(key, index, *columns, F.explode(starts).alias("start")).withColumn("start", F.col("start") * stride)


def hopping_windows(df: DataFrame, key: str, index: str, values: list[str], length: int = 30, stride: int = 15) -> DataFrame:
    """(key, start, missing_ratio, rows): `length` consecutive rows from every `stride`-th, full windows only.

    `index` numbers the rows of a key from 0. A row is missing if any value is; missing values read 0 in `rows`.
    """
    missing = F.lit(False)
    for v in values:
        missing = missing | F.col(v).isNull()
    row = F.array(*[F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v in values])
    held = _in_windows(df, key, index, length, stride, [missing.cast("double").alias("missing"), F.struct(F.col(index).alias("i"), row.alias("r")).alias("row")])
    full = held.groupBy(key, "start").agg(F.avg("missing").alias("missing_ratio"), F.array_sort(F.collect_list("row")).alias("rows")).where(F.size("rows") == length)
    return full.select(key, F.col("start").cast(df.schema[index].dataType).alias("start"), "missing_ratio", F.transform("rows", lambda x: x["r"]).alias("rows"))


def usable(windows: DataFrame, most: float = 0.3) -> DataFrame:
    """Windows with at most that share of missing rows, inclusive."""
    return windows.where(F.col("missing_ratio") <= most)


def summarize_windows(df: DataFrame, key: str, index: str, value: str, length: int, stride: int) -> DataFrame:
    """(key, start, n, mean, std, min, max, range) of one value per hopping window; full windows only."""
    c = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    held = _in_windows(df, key, index, length, stride, [c.alias("_c"), F.col(value).isNull().cast("double").alias("_missing")])
    stats = {"n": F.count(F.lit(1)), "mean": F.avg("_c"), "std": F.stddev_pop("_c"), "min": F.min("_c"), "max": F.max("_c"), "missing_ratio": F.avg("_missing")}
    out = held.groupBy(key, "start").agg(*[s.alias(n) for n, s in stats.items()]).where(F.col("n") == length)
    return out.withColumn("start", F.col("start").cast(df.schema[index].dataType)).withColumn("range", F.col("max") - F.col("min"))
