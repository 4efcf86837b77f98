"""Difference hashes of grey images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crop_borders(image: np.ndarray, level: float = 16) -> np.ndarray:
    """Without dark rows and columns at the edges; the whole image if all of it is dark."""
    bright = image > level
    rows, columns = np.flatnonzero(bright.any(1)), np.flatnonzero(bright.any(0))
    return image if not len(rows) else image[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1]


def _shrunk(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means on a coarser grid."""
    for axis, n in ((0, height), (1, width)):
        size = image.shape[axis]
        edge = np.linspace(0, size, n + 1)
        total = np.concatenate([np.zeros_like(image.take([0], axis)), image.cumsum(axis)], axis)
        low = np.floor(edge).astype(int)
        part = np.expand_dims(edge - low, 1 - axis)
        at = total.take(low, axis) + part * (total.take(np.minimum(low + 1, size), axis) - total.take(low, axis))
        image = np.diff(at, axis=axis) * n / size
    return image


def difference_hash(image: np.ndarray, size: int = 8, level: float = 16) -> int:
    """64 bits as a signed long: set where the right neighbour is brighter."""
    small = _shrunk(crop_borders(np.asarray(image, float), level), size, size + 1)
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    return int(np.packbits(bits).view(">i8")[0]) if bits.size == 64 else int("".join("01"[b] for b in bits.astype(int)), 2)


def hash_frames(df: DataFrame, image: str = "pixels", width: str = "width", name: str = "hash") -> DataFrame:
    """A column of hashes of flat grey images (array of numbers, row after row)."""
    @F.pandas_udf("bigint")
    def hashed(pixels: pd.Series, columns: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else difference_hash(np.asarray(p, float).reshape(-1, int(w))) for p, w in zip(pixels, columns, strict=True)], dtype="Int64")

    return df.withColumn(name, hashed(F.col(image), F.col(width)))
