"""Queries over keyed series: `events` by user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.kernels.counters import SignalCounter, SignalOptions, ThresholdCounter
from cadence.kernels.states import HoldTimer, RateLimiter, SessionKernel, ValueFilter
from cadence.operators import ordered, resample
from cadence.operators.replay import replay
from cadence.plans.registry import EVENTS, GRID, NEAREST, STEP, events, query, r6

KEY, ORDER = "user_id", ["t", "event_id"]
FAR = 21_600_000
_FILLED = f"""f AS (SELECT user_id, k, CASE WHEN abs(source_ms - grid_ms) <= {FAR} THEN value END AS value FROM n),
a AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN k END IGNORE NULLS) OVER p AS ai, last_value(value IGNORE NULLS) OVER p AS av,
  first_value(CASE WHEN value IS NOT NULL THEN k END IGNORE NULLS) OVER c AS bi, first_value(value IGNORE NULLS) OVER c AS bv FROM f
  WINDOW p AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), c AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
i AS (SELECT user_id, k, coalesce(value, CASE WHEN bi - ai - 1 <= 5 THEN (bv - av) / (bi - ai) * (k - ai) + av END) AS value FROM a)"""
_HEAD = f"WITH {EVENTS}, {GRID}, {NEAREST}"


def _nearest(spark: SparkSession, sf_dir: str, far: float | None = None) -> DataFrame:
    return resample.resample_nearest(events(spark, sf_dir), KEY, "t", ["value"], STEP, far)


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.fill_gaps(_nearest(spark, sf_dir, FAR).select(KEY, "k", "value"), KEY, "k", ["value"])


@query(f"""{_HEAD}, {_FILLED},
w AS (SELECT user_id, k, count(*) OVER x AS n, avg(coalesce(value, 0)) OVER x AS mean, max(coalesce(value, 0)) OVER x - min(coalesce(value, 0)) OVER x AS span, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END) OVER x AS missing FROM i
  WINDOW x AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)),
s AS (SELECT user_id, count(*) AS windows, round(avg(mean), 6) AS mean, round(avg(span), 6) AS span FROM w WHERE n = 30 AND k % 15 = 0 AND missing <= 0.3 GROUP BY user_id)
SELECT * FROM s ORDER BY span DESC, user_id LIMIT 20""")
def resample_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: resample, fill gaps, cut windows, drop those with much missing, summarise, and rank users."""
    w = resample.usable(resample.summarize_windows(_filled(spark, sf_dir), KEY, "k", "value", 30, 15))
    users = w.groupBy(KEY).agg(F.count("*").alias("windows"), r6(F.avg("mean")).alias("mean"), r6(F.avg("range")).alias("span"))
    return users.orderBy(F.desc("span"), KEY).limit(20)


@query(f"{_HEAD} SELECT user_id, k, grid_ms, source_ms, value FROM n")
def resample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select(KEY, "k", "grid_ms", "source_ms", "value")


@query(f"WITH {EVENTS}, {GRID} SELECT h.user_id, h.k, h.grid_ms, e.t AS source_ms, e.value FROM h ASOF JOIN e ON h.user_id = e.user_id AND h.grid_ms >= e.t")
def sample_and_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.sample_and_hold(events(spark, sf_dir), KEY, "t", ["value"], STEP)


@query(f"WITH {EVENTS}, {GRID} SELECT h.user_id, h.k, h.grid_ms, e.t AS source_ms, e.value FROM h ASOF JOIN e ON h.user_id = e.user_id AND h.grid_ms <= e.t")
def sample_on_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.sample_and_hold(events(spark, sf_dir), KEY, "t", ["value"], STEP, arrival=True)


@query(f"{_HEAD}, {_FILLED} SELECT user_id, k, round(value, 6) AS value FROM i")
def gap_fill_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).select(KEY, "k", r6("value").alias("value"))


@query(f"""{_HEAD}, {_FILLED},
w AS (SELECT user_id, k, list(coalesce(value, 0)) OVER x AS v, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END) OVER x AS missing FROM i WINDOW x AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING))
SELECT user_id, k AS start, round(missing, 6) AS missing_ratio, missing <= 0.3 AS usable, round(v[1], 6) AS first, round(v[30], 6) AS last FROM w WHERE len(v) = 30 AND k % 15 = 0""")
def hopping_row_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = resample.hopping_windows(_filled(spark, sf_dir), KEY, "k", ["value"])
    at = lambda i: r6(F.get(F.get("rows", F.lit(i)), F.lit(0)))
    return w.select(KEY, "start", r6("missing_ratio").alias("missing_ratio"), (F.col("missing_ratio") <= 0.3).alias("usable"), at(0).alias("first"), at(29).alias("last"))


@query(f"""{_HEAD}, {_FILLED},
w AS (SELECT user_id, k, count(*) OVER x AS n, avg(c) OVER x AS mean, stddev_pop(c) OVER x AS std, min(c) OVER x AS lo, max(c) OVER x AS hi FROM (SELECT *, coalesce(value, 0) AS c FROM i) WINDOW x AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING))
SELECT user_id, k AS start, round(mean, 6) AS mean, round(std, 6) AS std, round(lo, 6) AS min, round(hi, 6) AS max, round(hi - lo, 6) AS range FROM w WHERE n = 30 AND k % 15 = 0""")
def window_summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = resample.summarize_windows(_filled(spark, sf_dir), KEY, "k", "value", 30, 15)
    return s.select(KEY, "start", *[r6(c).alias(c) for c in ("mean", "std", "min", "max", "range")])


@query(f"""WITH RECURSIVE {EVENTS}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e),
r AS (SELECT user_id, event_id, n, value AS ema FROM s WHERE n = 1 UNION ALL SELECT s.user_id, s.event_id, s.n, 0.4 * s.value + 0.6 * r.ema FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1)
SELECT user_id, event_id, round(ema, 6) AS ema FROM r""")
def ema_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.ema(events(spark, sf_dir), KEY, ORDER, "value", 0.4).select(KEY, "event_id", r6("ema").alias("ema"))


@query(f"""WITH {EVENTS} SELECT user_id, event_id, round(quantile_cont(value, 0.05) OVER w, 6) AS low, round(quantile_cont(value, 0.95) OVER w, 6) AS high FROM e
WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def rolling_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = ordered.rolling_quantiles(events(spark, sf_dir), KEY, ORDER, "value")
    return q.select(KEY, "event_id", r6("low").alias("low"), r6("high").alias("high"))


@query(f"""WITH {EVENTS} SELECT user_id, event_id, count(value) OVER w AS n, round(avg(value) OVER w + 1e-9, 6) AS mean, round(var_pop(value) OVER w + 1e-7, 4) AS variance FROM e
WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def welford_running_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ordered.running_variance(events(spark, sf_dir), KEY, ORDER, "value")
    return v.select(KEY, "event_id", "n", r6(F.col("mean") + 1e-9).alias("mean"), F.round(F.col("variance") + 1e-7, 4).alias("variance"))


@query(f"""WITH {EVENTS}, p AS (SELECT *, coalesce(last_value(CASE WHEN value <= 20 THEN 'down' WHEN value >= 60 THEN 'up' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'up') AS phase FROM e),
b AS (SELECT *, phase = 'up' AND lag(phase, 1, 'up') OVER (PARTITION BY user_id ORDER BY t, event_id) = 'down' AS back FROM p)
SELECT user_id, CAST(count(*) FILTER (back) AS BIGINT) AS count FROM b GROUP BY user_id""")
def hysteresis_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = ordered.hysteresis(events(spark, sf_dir), KEY, ORDER, "value", 20, 60)
    return h.groupBy(KEY).agg(F.max("count").alias("count"))


@query(f"""WITH {EVENTS}, p AS (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS a FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, event_id, t, value FROM p WHERE value > b AND value >= a""")
def local_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.local_peaks(events(spark, sf_dir), KEY, ORDER, "value").select(KEY, "event_id", "t", "value")


def _high() -> Column:
    return F.col("value") > 50


@query(f"""WITH {EVENTS}, f AS (SELECT *, value > 50 AS ok, CASE WHEN (value > 50) <> lag(value > 50) OVER w THEN 1 ELSE 0 END AS turn FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
i AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY t, event_id) AS island FROM f)
SELECT user_id, event_id, ok AND t - min(t) OVER (PARTITION BY user_id, island) >= 86400000 AS visible FROM i""")
def debounce_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.debounce(events(spark, sf_dir), KEY, "t", ORDER, _high(), 86_400_000).select(KEY, "event_id", "visible")


@query(f"""WITH {EVENTS}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS island FROM e)
SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type, island ORDER BY t, event_id) AS streak FROM s""")
def streak_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ordered.streaks(events(spark, sf_dir), KEY, ORDER, "event_type")
    return s.select(KEY, "event_id", "event_type", F.col("streak").cast("long").alias("streak"))


@query(f"""WITH {EVENTS}, s AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 21600000 THEN 1 ELSE 0 END AS new FROM e),
i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) AS session FROM s)
SELECT user_id, session, min(t) AS start_ms, max(t) AS end_ms, count(*) AS n FROM i GROUP BY user_id, session""")
def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ordered.sessions(events(spark, sf_dir), KEY, "t", ORDER, 21_600_000)
    return s.select(KEY, F.col("session").cast("long").alias("session"), "start_ms", "end_ms", "n")


_HOLDS = f"""WITH {EVENTS}, o AS (SELECT *, value > 50 AS ok, last_value(CASE WHEN value > 50 THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS good FROM e),
b AS (SELECT *, CASE WHEN NOT ok AND t - good > 43200000 THEN 1 ELSE 0 END AS brk FROM o),
p AS (SELECT *, coalesce(sum(brk) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM b),
h AS (SELECT user_id, part, min(CASE WHEN ok THEN t END) AS start_ms, max(CASE WHEN ok THEN t END) AS end_ms, max(brk) AS closed FROM p GROUP BY user_id, part)
SELECT user_id, {{columns}} FROM h WHERE start_ms IS NOT NULL AND closed = 1 AND end_ms - start_ms >= 3600000"""


@query(_HOLDS.format(columns="start_ms, end_ms, end_ms - start_ms AS duration_ms"))
def hold_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.holds(events(spark, sf_dir), KEY, "t", ORDER, _high(), 43_200_000, 3_600_000)


@query(_HOLDS.format(columns="CAST(end_ms - start_ms AS DOUBLE) AS duration_ms"))
def hold_timer_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernel form of the same; equal to the window form."""
    e = events(spark, sf_dir).withColumn("ok", _high())
    out = replay(e, [KEY], ORDER, HoldTimer(43_200_000, 3_600_000), {"ts_ms": "t"})
    return out.where("ended_ms is not null").select(KEY, F.col("ended_ms").alias("duration_ms"))


_LIMIT = f"""WITH RECURSIVE {EVENTS}, s AS (SELECT user_id, t, event_type AS x, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e),
r AS (SELECT user_id, n, t, x AS said, t AS last, CAST(NULL AS VARCHAR) AS waiting FROM s WHERE n = 1
  UNION ALL SELECT s.user_id, s.n, s.t, CASE WHEN s.t - r.last >= 172800000 THEN s.x END, CASE WHEN s.t - r.last >= 172800000 THEN s.t ELSE r.last END, CASE WHEN s.t - r.last >= 172800000 THEN NULL ELSE s.x END
  FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1)
SELECT user_id, {{ms}} AS said_ms, said AS text FROM r WHERE said IS NOT NULL"""


@query(_LIMIT.format(ms="t"))
def rate_limit_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.rate_limit(events(spark, sf_dir), KEY, "t", ORDER, "event_type", 172_800_000)


@query(_LIMIT.format(ms="CAST(t AS DOUBLE)"))
def rate_limit_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("enabled", F.lit(None).cast("boolean"))
    return replay(e, [KEY], ORDER, RateLimiter(172_800_000), {"ts_ms": "t", "text": "event_type"})


_EURO = f"""WITH RECURSIVE {EVENTS}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e),
r AS (SELECT user_id, event_id, n, t, value AS x, CAST(0 AS DOUBLE) AS dx FROM s WHERE n = 1
  UNION ALL SELECT q.user_id, q.event_id, q.n, q.t, q.a * q.value + (1 - q.a) * q.px, q.dx FROM (
    SELECT z.*, 1 / (1 + 1 / (6.283185307179586 * (0.00001 + 0.0001 * abs(z.dx)) * z.dt)) AS a FROM (
      SELECT s.user_id, s.event_id, s.n, s.t, s.value, r.x AS px, (s.t - r.t) / 1000.0 AS dt,
        (1 / (1 + 1 / (6.283185307179586 * 0.00001 * ((s.t - r.t) / 1000.0)))) * ((s.value - r.x) / ((s.t - r.t) / 1000.0)) + (1 - 1 / (1 + 1 / (6.283185307179586 * 0.00001 * ((s.t - r.t) / 1000.0)))) * r.dx AS dx
      FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1) z) q)
SELECT user_id, event_id, round(x, 6) AS filtered FROM r"""


@query(_EURO)
def one_euro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.one_euro(events(spark, sf_dir), KEY, "t", ORDER, "value", 1e-5, 1e-4, 1e-5).select(KEY, "event_id", r6("filtered").alias("filtered"))


@query(f"""WITH RECURSIVE {EVENTS}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS d FROM e),
s AS (SELECT user_id, event_id, 1000.0 / d AS v, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM g WHERE d > 0),
r AS (SELECT user_id, event_id, n, CAST(v AS DOUBLE) AS fps FROM s WHERE n = 1 UNION ALL SELECT s.user_id, s.event_id, s.n, 0.1 * s.v + 0.9 * r.fps FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1)
SELECT user_id, event_id, round(fps, 6) AS fps FROM r""")
def smoothed_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.smoothed_rate(events(spark, sf_dir), KEY, "t", ORDER).select(KEY, "event_id", r6("fps").alias("fps"))


@query(_EURO.replace("SELECT user_id, event_id, round(x, 6)", "SELECT user_id, t, round(x, 6)"))
def one_euro_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return replay(e, [KEY], ORDER, ValueFilter(1e-5, 1e-4, 1e-5), {"ts_ms": "t"}).select(KEY, F.col("ts_ms").cast("long").alias("t"), r6("filtered").alias("filtered"))


@query()
def signal_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetitions of `events.value`, one sample an hour (times scaled so that an hour is one of the counter's samples)."""
    e = events(spark, sf_dir).withColumn("ts_ms", F.col("t") / 54_000)
    return replay(e, [KEY], ORDER, SignalCounter(SignalOptions(min_amplitude=8.0)))


@query(f"""WITH {EVENTS}, p AS (SELECT *, coalesce(last_value(CASE WHEN value <= 20 THEN 'down' WHEN value >= 60 THEN 'up' END IGNORE NULLS) OVER w, 'up') AS phase FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT *, CASE WHEN phase = 'up' AND lag(phase, 1, 'up') OVER (PARTITION BY user_id ORDER BY t, event_id) = 'down' THEN 1 ELSE 0 END AS back FROM p)
SELECT user_id, CAST(t AS DOUBLE) AS ts_ms, phase, CAST(sum(back) OVER (PARTITION BY user_id ORDER BY t, event_id) AS INT) AS count FROM b""")
def threshold_counter_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(events(spark, sf_dir), [KEY], ORDER, ThresholdCounter(20, 60, 40), {"ts_ms": "t"}).select(KEY, "ts_ms", "phase", "count")


@query()
def session_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full session machine: purchases count as repetitions, values over 30 as movement, 12 hours as rest."""
    none = lambda t: F.lit(None).cast(t)
    upto = Window.partitionBy(KEY).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    e = events(spark, sf_dir).withColumns({"kind": none("string"), "label": none("string"), "confidence": none("double"), "uncertain": none("boolean"), "moving": F.col("value") > 30, "reps": F.sum((F.col("event_type") == "purchase").cast("int")).over(upto), "hold_ms": F.lit(0.0), "holding": F.lit(False), "warning": F.col("value") > 90})
    return replay(e, [KEY], ORDER, SessionKernel(rest_ms=43_200_000, started=True), {"ts_ms": "t"})


@query(f"""WITH {EVENTS}, d AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM e)
SELECT count(*) AS n, round(quantile_cont(gap, 0.5), 3) AS median, round(quantile_cont(gap, 0.95), 3) AS p95, round(avg(gap), 3) AS mean, max(gap) AS max FROM d WHERE gap IS NOT NULL""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadence.operators.metrics import describe

    gap = F.col("t") - F.lag("t").over(Window.partitionBy(KEY).orderBy(*ORDER))
    d = describe(events(spark, sf_dir).select(gap.alias("gap")), "gap")
    return d.select("n", *[F.round(c, 3).alias(c) for c in ("median", "p95", "mean")], "max")


@query(f"WITH {EVENTS} SELECT user_id, round((count(*) - 1) * 1000.0 / nullif(max(t) - min(t), 0), 9) AS fps FROM e GROUP BY user_id")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadence.operators import metrics

    return metrics.throughput(events(spark, sf_dir), KEY, "t").select(KEY, F.round("fps", 9).alias("fps"))


@query(f"""WITH {EVENTS}, c AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cycle FROM e)
SELECT user_id, CAST(cycle AS BIGINT) AS cycle, max(value) AS extreme FROM c GROUP BY user_id, cycle HAVING max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) = 1""")
def cycle_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ordered.last_per_cycle(events(spark, sf_dir), KEY, ORDER, "value", F.col("event_type") == "purchase")
    return c.select(KEY, F.col("cycle").cast("long").alias("cycle"), "extreme")
