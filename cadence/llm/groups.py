"""Groups of rows: streaming whole ones out of sorted Arrow batches, spanning their links, and dealing large ones to blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.session import cut, shuffle_width


def changes(columns: list[pa.Array]) -> np.ndarray:
    """Starts of runs of equal keys."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        v = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        if isinstance(v, pa.ChunkedArray):
            v = pa.concat_arrays(v.chunks)
        x = v.to_numpy(zero_copy_only=False)
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups with the start of each group. Input must be sorted so that groups are contiguous."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            old = [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in keys]
            if old == [batch.column(k)[batch.num_rows - 1].as_py() for k in keys] and old == [batch.column(k)[0].as_py() for k in keys]:
                held.append(batch)
                continue
        table = pa.Table.from_batches([*held, batch])
        starts = changes([table.column(k) for k in keys])
        cut = int(starts[-1])
        if cut:
            yield table.slice(0, cut), starts[:-1]
        held = table.slice(cut).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, changes([table.column(k) for k in keys])


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node) that span the same components as the edges a - b: the smallest label in sight goes
    along all edges and down all trees until none changes."""
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = place[: len(a)], place[len(a) :]
    root = np.arange(len(names))
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    other = root != np.arange(len(names))
    return names[other], names[root[other]]


def in_blocks(df: DataFrame, keys: list[str], row: str, load: Column, most: int) -> DataFrame:
    """Rows of groups of two rows or more, with `blocks`, of about `most` load each, and the block `side` of each row.

    Totals are pre-aggregated, and what is joined back is a written table with a row per group, so that adaptive execution
    can split a hot group; side is a hash of the row.
    """
    total = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(load).alias("load")).where("n > 1")
    total = cut(total.select(*keys, F.ceil(F.col("load") / most).cast("int").alias("blocks")))
    return df.join(total, keys).withColumn("side", F.pmod(F.xxhash64(row, F.lit(1)), F.col("blocks")).cast("int"))


def in_cells(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with `side` of `blocks` in every cell (one <= two) they belong to, dealt and sorted by keys and cell."""
    spread = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumn("one", F.least("side", "other")).withColumn("two", F.greatest("side", "other")).drop("other", "blocks")
    return spread.repartition(shuffle_width(df.sparkSession), *keys, "one", "two").sortWithinPartitions(*keys, "one", "two")
