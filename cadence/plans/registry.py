from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.operators.resample import epoch_millis

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name; sql is the same in DuckDB."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, event_type, value, t): t in whole milliseconds."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", epoch_millis(F.col("ts")).alias("t"))


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


#: The same as `events`, and a 12-hour grid, as SQL common table expressions.
EVENTS = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS t FROM events)"
STEP = 43_200_000
GRID = f"g AS (SELECT user_id, min(t) AS t0, unnest(range(0, CAST(floor((max(t) - min(t)) / {STEP}) AS BIGINT) + 1)) AS k FROM e GROUP BY user_id), h AS (SELECT user_id, CAST(k AS INT) AS k, CAST(t0 + k * {STEP} AS DOUBLE) AS grid_ms FROM g)"
NEAREST = "n AS (SELECT * FROM (SELECT h.user_id, h.k, h.grid_ms, e.t AS source_ms, e.value, row_number() OVER (PARTITION BY h.user_id, h.k ORDER BY abs(e.t - h.grid_ms), e.t) AS r FROM h JOIN e USING (user_id)) WHERE r = 1)"
