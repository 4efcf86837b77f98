"""Ordered operators that window functions and array folds can express, by key and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cadence.kernels.base import Kernel
from cadence.kernels.states import Ema, RateLimiter, ValueFilter
from cadence.operators.replay import replay


def _order(key: str, *by: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(*by)


class _Beside(Kernel):
    """Carries order columns through a kernel that emits one row per value."""

    def __init__(self, inner: Kernel, extra: int) -> None:
        self.inner = inner
        self.inputs = ("ts_ms", "value", *[f"o{k}" for k in range(extra)])

    def start(self):
        return self.inner.start()

    def step(self, s, row):
        s, out = self.inner.step(s, row[:2])
        return s, [(*row[2:], r[-1]) for r in out]


def _replayed(df: DataFrame, key: str, order: list[str], kernel: Kernel, time: str | None, value: str, name: str) -> DataFrame:
    """A kernel with one row out per present value, beside the order columns of that row."""
    rows = df.where(F.col(value).isNotNull())
    out = replay(rows, [key], order, _Beside(kernel, len(order)), {"ts_ms": time or order[0], "value": value, **{f"o{k}": o for k, o in enumerate(order)}}, ", ".join(f"o{k} {df.schema[o].dataType.simpleString()}" for k, o in enumerate(order)))
    return out.select(key, *[F.col(f"o{k}").alias(o) for k, o in enumerate(order)], F.col("v").alias(name))


def ema(df: DataFrame, key: str, order: list[str], value: str, weight: float, name: str = "ema") -> DataFrame:
    """weight * x + (1 - weight) * previous, seeded by the first value; missing values are passed over. A kernel, so the work
    grows with the rows of a key and not with their square."""
    return _replayed(df, key, order, Ema(weight), None, value, name)


def rolling_quantiles(df: DataFrame, key: str, order: list[str], value: str, rows: int = 60, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Linear-interpolated quantiles of the trailing `rows` values."""
    trail = _order(key, *order).rowsBetween(-(rows - 1), 0)
    q = F.percentile(value, F.array(F.lit(low), F.lit(high))).over(trail)
    return df.withColumn("_q", q).select(*df.columns, F.get("_q", F.lit(0)).alias("low"), F.get("_q", F.lit(1)).alias("high"))


def running_variance(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Running count, mean, population variance and sum of squared deviations."""
    upto = _order(key, *order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({"n": F.count(value).over(upto), "mean": F.avg(value).over(upto), "variance": F.var_pop(value).over(upto)})
    return out.withColumn("m2", F.col("variance") * F.col("n"))


def hysteresis(df: DataFrame, key: str, order: list[str], value: str, down: float, up: float) -> DataFrame:
    """Rows with `phase` (starting up) and running `count` of returns from down (value <= down) to up (value >= up)."""
    upto = _order(key, *order).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col(value) <= down, "down").when(F.col(value) >= up, "up")
    phased = df.withColumn("phase", F.coalesce(F.last(mark, ignorenulls=True).over(upto), F.lit("up")))
    back = (F.col("phase") == "up") & (F.lag("phase", 1, "up").over(_order(key, *order)) == "down")
    return phased.withColumn("count", F.sum(back.cast("long")).over(upto))


def local_peaks(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows above the row before and not below the row after."""
    w = _order(key, *order)
    return df.withColumns({"_b": F.lag(value).over(w), "_a": F.lead(value).over(w)}).where((F.col(value) > F.col("_b")) & (F.col(value) >= F.col("_a"))).drop("_b", "_a")


def islands(df: DataFrame, key: str, order: list[str], flag: Column, name: str = "island") -> DataFrame:
    """Number runs of rows on which `flag` keeps its value."""
    w = _order(key, *order)
    marked = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    turned = marked.withColumn("_t", (F.col("_f") != F.lag("_f").over(w)).cast("int"))
    return turned.withColumn(name, F.sum(F.coalesce("_t", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_t").withColumnRenamed("_f", f"{name}_on")


def debounce(df: DataFrame, key: str, time: str, order: list[str], flag: Column, hold_ms: float = 500) -> DataFrame:
    """`visible` once the flag has held for `hold_ms` without a break."""
    run = islands(df, key, order, flag)
    since = F.min(time).over(Window.partitionBy(key, "island"))
    return run.withColumn("visible", F.col("island_on") & (F.col(time) - since >= hold_ms)).drop("island")


def holds(df: DataFrame, key: str, time: str, order: list[str], flag: Column, grace_ms: float = 400, least_ms: float = 1000) -> DataFrame:
    """(key, start_ms, end_ms, duration_ms) of holds that ended: a false row more than `grace_ms` after the last true row
    closes a hold, however long true rows lie apart. A hold still open at the end is not among them."""
    w = _order(key, *order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    on = F.coalesce(flag, F.lit(False))
    rows = df.withColumn("_on", on).withColumn("_good", F.last(F.when(F.col("_on"), F.col(time)), ignorenulls=True).over(upto))
    broken = rows.withColumn("_end", (~F.col("_on") & (F.col(time) - F.col("_good") > grace_ms)).cast("int"))
    part = broken.withColumn("_part", F.coalesce(F.sum("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    found = part.groupBy(key, "_part").agg(F.min(F.when(F.col("_on"), F.col(time))).alias("start_ms"), F.max(F.when(F.col("_on"), F.col(time))).alias("end_ms"), F.max("_end").alias("closed"))
    return found.where("start_ms is not null and closed = 1").select(key, "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms")).where(F.col("duration_ms") >= least_ms)


def streaks(df: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """`streak`: how many equal labels in a row, up to and with this one."""
    w = _order(key, *order)
    fresh = F.coalesce((~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int"), F.lit(1))
    first = F.when(F.row_number().over(w) == 1, 1).otherwise(fresh)
    part = df.withColumn("_part", first).withColumn("_part", F.sum("_part").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return part.withColumn("streak", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))).drop("_part")


def sessions(df: DataFrame, key: str, time: str, order: list[str], gap_ms: float) -> DataFrame:
    """(key, session, start_ms, end_ms, n): rows at most `gap_ms` apart belong together."""
    w = _order(key, *order)
    new = F.coalesce((F.col(time) - F.lag(time).over(w) > gap_ms).cast("int"), F.lit(0))
    part = df.withColumn("_n", new).withColumn("session", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy(key, "session").agg(F.min(time).alias("start_ms"), F.max(time).alias("end_ms"), F.count("*").alias("n"))


def rate_limit(df: DataFrame, key: str, time: str, order: list[str], text: str, gap_ms: float = 2000) -> DataFrame:
    """(key, said_ms, text): the newest waiting text, released by the first row at least `gap_ms` after the last release.
    Rows without text may release too; rows without a time are passed over."""
    rows = df.where(F.col(time).isNotNull()).withColumn("_on", F.lit(None).cast("boolean"))
    said = replay(rows, [key], order, RateLimiter(gap_ms), {"ts_ms": time, "text": text, "enabled": "_on"})
    return said.select(key, F.col("said_ms").cast("bigint").alias("said_ms"), "text")


def one_euro(df: DataFrame, key: str, time: str, order: list[str], value: str, min_cutoff: float = 1.0, beta: float = 10.0, d_cutoff: float = 1.0) -> DataFrame:
    """The adaptive low-pass: cutoff = min_cutoff + beta * |smoothed speed|. The first row, and rows on which time does not
    advance, pass through and reset the speed; rows without a value are passed over."""
    return _replayed(df, key, order, ValueFilter(min_cutoff, beta, d_cutoff), time, value, "filtered")


def smoothed_rate(df: DataFrame, key: str, time: str, order: list[str], weight: float = 0.1) -> DataFrame:
    """(key, order, fps): smoothed rows per second."""
    w = _order(key, *order)
    step = (F.col(time) - F.lag(time).over(w)).cast("double")
    return ema(df.withColumn("_rate", F.when(step > 0, F.lit(1000.0) / step)), key, order, "_rate", weight, "fps")


def count_rises(df: DataFrame, key: str, order: list[str], count: str) -> DataFrame:
    """Rows on which a running count is larger than on the row before."""
    return df.withColumn("_b", F.lag(count, 1, 0).over(_order(key, *order))).where(F.col(count) > F.col("_b")).drop("_b")


def next_open(entries: DataFrame, index: str, done: Column, start: int, n: int) -> DataFrame:
    """(next): the first entry after `start`, wrapping around, that is not done."""
    away = F.pmod(F.col(index) - F.lit(start + 1), F.lit(n))
    return entries.where(~done).agg(F.min_by(index, away).alias("next"))


def last_per_cycle(df: DataFrame, key: str, order: list[str], value: str, finished: Column, keep_max: bool = True) -> DataFrame:
    """(key, cycle, extreme): the extreme of a value from one finished cycle to the next; the finishing row still belongs to it."""
    w = _order(key, *order).rowsBetween(Window.unboundedPreceding, -1)
    part = df.withColumn("cycle", F.coalesce(F.sum(F.coalesce(finished, F.lit(False)).cast("int")).over(w), F.lit(0)))
    closed = F.max(F.coalesce(finished, F.lit(False)).cast("int")).alias("closed")
    return part.groupBy(key, "cycle").agg((F.max if keep_max else F.min)(value).alias("extreme"), closed).where("closed = 1").drop("closed")


def time_scale(rows: Column, scale: Column) -> Column:
    """A window of values read at `scale` times the pace: linear between rows, clamped at the ends."""
    last = F.size(rows) - 1

    def at(i: Column) -> Column:
        p = F.least(F.greatest(i * scale, F.lit(0.0)), last.cast("double"))
        low = F.floor(p).cast("int")
        high = F.least(low + 1, last)
        return F.get(rows, low) + (F.get(rows, high) - F.get(rows, low)) * (p - low)

    return F.transform(F.sequence(F.lit(0), last), at)
