"""Approximate nearest neighbours by a hash-prefix forest (operator 1).

A block of rows is indexed in trees. A tree gives each vector a string of symbols, each the direction that is nearest
to the vector among a few random ones and their opposites, and keeps the strings in a sorted array. A query descends all
trees to the rows with the longest common prefixes and ascends them together, symbol by symbol, until it has met enough
different rows; those are compared exactly.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.llm.groups import runs
from cadence.llm.vectors import cosines, matrix, usable
from cadence.session import bound_arrow, shuffle_width

FOUND = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Forest:
    """`trees` strings of `depth` symbols over 2 * `directions` symbols; a query ascends until it has met `share` of a
    block's rows, `least` at any rate. Blocks of about `block` rows and `queries` queries meet in one cell.

    Strings of 8 symbols over 32 have 40 bits, so clusters of near copies come apart before a query has to meet them all.
    Where vectors lie in all directions alike, neighbours are hardly nearer than strangers: two symbols then meet 24 % of
    a block, one more symbol 1.6 % with a recall of 0.42 only, and finer alphabets need the same share for that recall."""

    trees: int = 208
    depth: int = 8
    directions: int = 16
    share: float = 0.08
    least: int = 256
    block: int = 8192
    queries: int = 8192
    seed: int = 1


@functools.lru_cache(maxsize=4)
def _directions(forest: Forest, dim: int) -> np.ndarray:
    rng = np.random.default_rng((forest.seed, dim))
    return rng.standard_normal((forest.trees, dim, forest.depth * forest.directions), np.float32)


def _strings(forest: Forest, x: np.ndarray, tree: int) -> np.ndarray:
    p = (x @ _directions(forest, x.shape[1])[tree]).reshape(len(x), forest.depth, forest.directions)
    best = np.abs(p).argmax(2)
    symbol = 2 * best + (np.take_along_axis(p, best[:, :, None], 2)[:, :, 0] < 0)
    out = np.zeros(len(x), np.int64)
    for k in range(forest.depth):
        out = out * (2 * forest.directions) + symbol[:, k]
    return out


def search(forest: Forest, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """Up to k nearest rows found for each query, rows of the query's own id left out."""
    n, m, width = len(x), len(q), 2 * forest.directions
    unit = lambda v: (v / np.sqrt((v * v).sum(1))[:, None]).astype(np.float32)
    ux, uq = unit(x), unit(q)
    order = np.empty((forest.trees, n), np.int32)
    low, high = np.empty((2, forest.depth, forest.trees, m), np.int32)
    for t in range(forest.trees):
        strings = _strings(forest, ux, t)
        order[t] = np.argsort(strings, kind="stable")
        strings, mine = strings[order[t]], _strings(forest, uq, t)
        for d in range(forest.depth):
            step = width**d  # prefixes of depth - d symbols
            first = mine // step * step
            low[d, t] = np.searchsorted(strings, first)
            high[d, t] = np.searchsorted(strings, first + step)
    wanted = min(n, max(forest.least, int(forest.share * n)))
    met = (high - low).sum(1)
    out = []
    for i in range(m):
        seen = np.zeros(n, bool)
        for d in range(forest.depth):
            if met[d, i] >= wanted:
                for t in range(forest.trees):
                    seen[order[t, low[d, t, i] : high[d, t, i]]] = True
                if seen.sum() >= wanted:
                    break
        else:
            seen[:] = True
        seen[ids == query_ids[i]] = False
        near = np.flatnonzero(seen)
        score = cosines(x[near], q[i])
        if len(near) > k:
            floor = np.partition(score, len(near) - k)[len(near) - k]
            near, score = near[score >= floor], score[score >= floor]
        best = np.lexsort((ids[near], -score))[:k]
        out += [(int(query_ids[i]), int(ids[near[b]]), float(score[b])) for b in best]
    return out


def _once(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row per id, of several the first in the order of components."""
    order = np.lexsort((*x.T[::-1], ids))
    first = np.ones(len(ids), bool)
    first[1:] = ids[order][1:] != ids[order][:-1]
    return ids[order][first], x[order][first]


def _cells(forest: Forest, k: int):
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, ["dim", "q_block", "r_block"]):
            for i, j in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
                cell = table.slice(int(i), int(j - i)).combine_chunks()
                asks = cell.column("ask").to_numpy(zero_copy_only=False).astype(bool)
                ids, x = cell.column("vec_id").to_numpy(), matrix(cell.column("embedding"))
                if asks.all() or not asks.any():
                    continue
                found = search(forest, *_once(ids[~asks], x[~asks]), *_once(ids[asks], x[asks]), k)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    return searched


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, forest: Forest = Forest()) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k nearest rows found, by cosine in double precision.

    vectors and queries: (vec_id, embedding). Rows fall into blocks by a hash of their id, queries into larger ones;
    each pair of blocks is one cell with a forest of its own, and the few best per query and cell are merged. Blocks are
    of a fixed size, so memory and recall in a cell do not depend on the input; the number of cells is that of all row
    blocks times query blocks. Vectors that are null, empty or zero or have null or non-finite components take no part;
    vectors meet only those of their length; rows of the query's id are its own; of repeated ids one row takes part; ties
    go to the smaller vec_id; other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    bound_arrow(spark)
    pick = lambda df: df.select(df["vec_id"].cast("long").alias("vec_id"), df["embedding"].cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).withColumn("dim", F.size("embedding"))
    rows, asks = pick(vectors), pick(queries)
    r_blocks, q_blocks = (max(1, -(-df.count() // size)) for df, size in ((rows, forest.block), (asks, forest.queries)))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = rows.select("dim", every(q_blocks).alias("q_block"), block(r_blocks).alias("r_block"), F.lit(False).alias("ask"), "vec_id", "embedding").unionByName(
        asks.select("dim", block(q_blocks).alias("q_block"), every(r_blocks).alias("r_block"), F.lit(True).alias("ask"), "vec_id", "embedding")
    )
    cells = both.repartition(shuffle_width(spark), "dim", "q_block", "r_block").sortWithinPartitions("dim", "q_block", "r_block")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = cells.mapInArrow(_cells(forest, k), FOUND).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
