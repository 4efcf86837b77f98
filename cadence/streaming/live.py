"""A live workout as one streaming query: frames and controls in, counts, warnings, speech and closed sets out.

    frames ----> windows (state) ----> model ----> scores --+
       |                                                    |
       +----------------------------------------------------+--> workout (state) --> rows
    controls -----------------------------------------------+

Both stateful steps share one watermark, which passes through the first, so that in each batch the second sees the scores of
all frames that it is about to take. Rows of one key and time come in the order of controls, frames, scores.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.kernels.windows import MISSING, TimedWindows
from cadence.kernels.workout import Workout
from cadence.operators.models import scores_of
from cadence.operators.replay import replay
from cadence.streaming import keyed

#: Columns of the workout's input beside keys and event time, with their types.
COLUMNS = {"ts_ms": "double", "rank": "int", "kind": "string", "label": "string", "enabled": "boolean", "scores": "array<double>", "poor_pose": "boolean", "pose": "array<struct<x:double,y:double,z:double,visibility:double>>", "width": "double", "height": "double"}
CONTROL, FRAME, SCORE = 0, 1, 2
ORDER = ["ts_ms", "rank"]


def _shaped(df: DataFrame, keys: list[str], time: str | None, rank: int) -> DataFrame:
    """Columns of the workout's input, NULL where a row has none."""
    have = df.withColumn("rank", F.lit(rank))
    return have.select(*keys, *([time] if time else []), *[(F.col(c) if c in have.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


def _scored(windows: DataFrame, predict: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    return windows.withColumns({"kind": F.lit("scores"), "scores": scores_of(F.col("rows"), predict), "poor_pose": F.col("missing_ratio") > MISSING})


def with_controls(frames: DataFrame, controls: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Frames and controls of two streams as one, each with the watermark that it brings.

    A control (`kind` start, stop, choose with `label`, speech with `enabled`, forget) takes effect at its own event time
    among the frames of its key, however much later than they it arrives, up to the lateness of its watermark. The query's
    watermark is that of the slower stream, so a feed of controls has to move on: rows of kind tick do nothing else.
    """
    return _shaped(controls, keys, time, CONTROL).unionByName(_shaped(frames, keys, time, FRAME))


def live_workout(frames: DataFrame, controls: DataFrame, keys: list[str], time: str, predict: Callable[[np.ndarray], np.ndarray], labels: list[str], idle_ms: int = 60_000) -> DataFrame:
    """(keys, rows of `Workout`) of two streams with watermarks on `time`; scores of the model on each window are fed back
    into the state at the time of the frame that released it. Equal to `two_pass` over the stored rows."""
    windows = keyed.run(frames, keys, time, TimedWindows(), ["ts_ms"], None, idle_ms, event_time=time)
    fed = with_controls(frames, controls, keys, time).unionByName(_shaped(_scored(windows, predict), keys, time, SCORE))
    return keyed.run(fed, keys, time, Workout(labels), ORDER, None, idle_ms)


def two_pass(frames: DataFrame, controls: DataFrame, keys: list[str], predict: Callable[[np.ndarray], np.ndarray], labels: list[str]) -> DataFrame:
    """The same over stored frames and controls: the windows of a first pass are scored and join the rows of the second."""
    windows = replay(frames, keys, ["ts_ms"], TimedWindows())
    rows = [_shaped(controls, keys, None, CONTROL), _shaped(frames, keys, None, FRAME), _shaped(_scored(windows, predict), keys, None, SCORE)]
    return replay(rows[0].unionByName(rows[1]).unionByName(rows[2]), keys, ORDER, Workout(labels))
