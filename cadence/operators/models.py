"""Summary features of windows, and models as batched plug-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions.geometry import JOINTS, POINTS

STATISTICS = ("mean", "std", "min", "max", "range")


def feature_names() -> list[str]:
    base = [f"p{p}_{c}" for p in range(POINTS) for c in ("x", "y", "visibility")] + [f"angle{a}" for a in range(JOINTS)]
    return [f"{s}_{b}" for s in STATISTICS for b in base] + [f"frequency_angle{a}" for a in range(JOINTS)]


def dominant_frequency(x: np.ndarray, fps: float) -> np.ndarray:
    """Per series (the last axis is time) the frequency of the largest spectral line but the constant; 0 for constant or
    very short series."""
    if x.shape[-1] < 2:
        return np.zeros(x.shape[:-1])
    power = np.abs(np.fft.rfft(x - x.mean(-1, keepdims=True), axis=-1))[..., 1:]
    best = np.fft.rfftfreq(x.shape[-1], 1 / fps)[1:][power.argmax(-1)]
    return np.where(power.max(-1) > 1e-12, best, 0.0)


def _stack(rows: pd.Series) -> np.ndarray:
    return np.stack([np.stack([np.asarray(v, float) for v in w]) for w in rows])


def summary_features(windows: DataFrame, fps: float = 15.0) -> DataFrame:
    """Windows with `summary`: mean, population deviation, minimum, maximum and range of every column, and the dominant
    frequency of every joint angle."""
    schema = windows.schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x = _stack(frame["rows"])
            parts = [x.mean(1), x.std(1), x.min(1), x.max(1), x.max(1) - x.min(1), dominant_frequency(x[:, :, 3 * POINTS :].transpose(0, 2, 1), fps)]
            yield frame.assign(summary=list(np.concatenate(parts, 1)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return windows.mapInPandas(run, fields + ", summary array<double>")


def class_scores(windows: DataFrame, predict: Callable[[np.ndarray], np.ndarray], batch: int = 256) -> DataFrame:
    """Windows with `scores`: what a model says of (n, time, features) batches. The model comes with the function, once per
    task."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                yield part.assign(scores=[np.asarray(s, float) for s in predict(_stack(part["rows"]))])

    return windows.mapInPandas(run, fields + ", scores array<double>")


def scores_of(rows: Column, predict: Callable[[np.ndarray], np.ndarray], batch: int = 256) -> Column:
    """What a model says of each window, as a column; unlike a map over frames it keeps the watermark of a stream."""

    @F.pandas_udf("array<double>")
    def score(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for frame in frames:
            out = [np.asarray(s, float) for k in range(0, len(frame), batch) for s in predict(_stack(frame.iloc[k : k + batch]))]
            yield pd.Series(out, index=frame.index, dtype=object)

    return score(rows)


def onnx_model(path: str, input_name: str | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """A plug-in that runs an ONNX file; the session is opened on first use in each worker."""
    held: dict[str, object] = {}

    def predict(x: np.ndarray) -> np.ndarray:
        if "session" not in held:
            import onnxruntime

            held["session"] = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        session = held["session"]
        name = input_name or session.get_inputs()[0].name
        return session.run(None, {name: x.astype(np.float32)})[0]

    return predict


def evaluate_models(windows: DataFrame, models: dict[str, Callable[[np.ndarray], np.ndarray]], key: str, truth: str) -> DataFrame:
    """(model, key, truth, predicted): each model's mean scores per key and the label they give."""
    from cadence.operators.metrics import mean_vectors

    out = None
    labels = windows.groupBy(key).agg(F.min(truth).alias("truth"))
    for name, predict in models.items():
        mean = mean_vectors(class_scores(windows, predict), key, "scores")
        best = mean.select(key, (F.array_position("mean", F.array_max("mean")) - 1).cast("int").alias("predicted"))
        rows = labels.join(best, key).select(F.lit(name).alias("model"), key, "truth", "predicted")
        out = rows if out is None else out.unionByName(rows)
    return out
