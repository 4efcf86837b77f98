"""Numbers and hash samples without a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.session import cut


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """Rows numbered from 0 in order of `by`, without one task that sees them all: ranges are sorted by themselves, and
    start where the counts of the ranges before them end (one row per range)."""
    ranged = cut(df.repartitionByRange(by).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("_range", before.alias("_start")))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(by)) - 1
    return ranged.join(starts, "_range").withColumn(name, F.col("_start") + place).drop("_range", "_start")


def first_by_hash(df: DataFrame, hashed: str, take: int, then: list[str], bits: int = 32, cell_bits: int = 16) -> DataFrame:
    """The `take` rows with the smallest (hash, then): counts per cell of hashes tell where they end, and only the cell in
    which they end is put in order. hash: a long below 2 ** bits."""
    width = 1 << (bits - cell_bits)
    celled = df.withColumn("_cell", F.floor(F.col(hashed) / width))
    counts = celled.groupBy("_cell").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = F.broadcast(counts.withColumn("_before", before).where(F.col("_before") < take))
    held = celled.join(cells, "_cell")
    whole = held.where(F.col("_before") + F.col("_n") <= take)
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy(hashed, *then))
    edge = held.where(F.col("_before") + F.col("_n") > take).withColumn("_r", rank).where(F.col("_before") + F.col("_r") <= take).drop("_r")
    return whole.unionByName(edge).drop("_cell", "_n", "_before")
