"""Near-duplicates by 64-bit perceptual hashes: banded self-join, exact distances, components."""

from __future__ import annotations

from itertools import combinations
from math import comb, floor
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions.scalars import group_name, hamming
from cadence.operators.graph import connected_components
from cadence.operators.skew import numbered
from cadence.session import cut


#: Rows of the stated side of a distance matrix.
MOST = 10_000


def mean_distance(a: str, b: str):
    pairs = F.zip_with(F.col(a), F.col(b), hamming)
    return F.try_divide(F.aggregate(pairs, F.lit(0), lambda s, d: s + d).cast("double"), F.size(a).cast("double"))


def distance_matrix(hashed: DataFrame, other: DataFrame, id_col: str = "id", hashes: str = "hashes") -> DataFrame:
    """(a, b, distance) of a stated set against all rows; the set is broadcast, so it holds MOST rows at most."""
    if other.limit(MOST + 1).count() > MOST:
        raise ValueError(f"distance_matrix takes at most {MOST} rows against all others")
    left = other.select(F.col(id_col).alias("a"), F.col(hashes).alias("_a"))
    right = hashed.select(F.col(id_col).alias("b"), F.col(hashes).alias("_b"))
    return right.join(F.broadcast(left), F.lit(True)).select("a", "b", mean_distance("_a", "_b").alias("distance"))


HASH_BITS = 64

#: Rows of a band's flip table, each a copy of a row on one side of the join.
MOST_FLIPS = 20_000

#: What a copy that is shuffled and sorted costs beside a candidate whose distance is taken.
COPY_COST = 8


class Band(NamedTuple):
    """Bits [start, start + width) of a hash; one side of the join flips up to `left` of them, the other up to `right`."""

    start: int
    width: int
    left: int
    right: int

    @property
    def copies(self) -> int:
        return _within(self.width, self.left) + _within(self.width, self.right)

    def meetings(self, rows: int) -> float:
        """Rows of unrelated hashes that a row meets."""
        return rows * _within(self.width, self.left) * _within(self.width, self.right) / 2.0**self.width


def _within(width: int, flips: int) -> int:
    return sum(comb(width, k) for k in range(flips + 1))


def _cost(bands: list[Band], rows: int) -> float:
    return sum(COPY_COST * b.copies + b.meetings(rows) for b in bands)


def bands_for(rows: int, threshold: int) -> list[Band]:
    """How hashes within `threshold` bits of each other are brought together at the least cost a row.

    The bits are dealt to m bands and the flips r to them so that the sum of (r + 1) is threshold + 1: flips that no band has
    room for would add up to more than the threshold, so no pair is lost. The fewer the bands, the wider the keys and the
    rarer strangers, but the more copies a row needs; the number of rows decides.
    """
    best: list[Band] = []
    for m in range(1, min(threshold + 1, HASH_BITS) + 1):
        bands, start = [], 0
        for i in range(m):
            width, flips = HASH_BITS // m + (i < HASH_BITS % m), (threshold + 1) // m + (i < (threshold + 1) % m) - 1
            ways = [Band(start, width, flips - right, right) for right in range(flips // 2 + 1)]
            ways = [w for w in ways if _within(width, w.left) <= MOST_FLIPS]
            if not ways:
                break
            bands.append(min(ways, key=lambda w: _cost([w], rows)))
            start += width
        if len(bands) == m and (not best or _cost(bands, rows) < _cost(best, rows)):
            best = bands
    return best


def _flip_table(spark: SparkSession, bands: list[Band], side: str) -> DataFrame:
    """(band, flip): every set of up to so many bits of a band; MOST_FLIPS rows a band at most."""
    rows = [(k, sum(1 << i for i in which)) for k, b in enumerate(bands) for n in range(getattr(b, side) + 1) for which in combinations(range(b.width), n)]
    return spark.createDataFrame([(k, v - (1 << 64) if v >> 63 else v) for k, v in rows], "band int, flip long")


def near_pairs(hashed: DataFrame, threshold: float, id_col: str = "id", hashes: str = "hashes") -> DataFrame:
    """(a, b, distance) with a < b and a mean Hamming distance over the rows' hashes of at most `threshold`.

    A mean of at most t means that some hash differs in at most t bits. Rows meet in an equi-join of (hash number, band,
    key), where each side brings the keys with a few bits of the band flipped; `bands_for` takes widths and flips from the
    number of distinct rows, so keys widen as the table grows. Copies carry an id and one hash; all hashes of a row are
    fetched for pairs that one hash lets through. Rows with equal hashes are one row of the join. Rows whose hashes are
    missing pair with nothing.
    """
    usable = hashed.where(F.col(hashes).isNotNull() & F.forall(hashes, lambda h: h.isNotNull()) & (F.size(hashes) > 0))
    classes = cut(usable.groupBy(F.col(hashes).alias("h")).agg(F.min(id_col).alias("rep")))
    reach = min(floor(threshold), HASH_BITS)
    bands = bands_for(classes.count(), reach) if reach >= 0 else []
    key = lambda b: F.shiftrightunsigned("one", b.start).bitwiseAND(F.lit(-1 if b.width == HASH_BITS else (1 << b.width) - 1).cast("long"))
    parts = F.array(*[F.struct(F.lit(k).alias("band"), key(b).alias("bits")) for k, b in enumerate(bands)]) if bands else F.array().cast("array<struct<band:int,bits:bigint>>")
    keyed = classes.select("rep", F.size("h").alias("size"), F.posexplode("h").alias("n", "one")).select("rep", "size", "n", "one", F.explode(parts).alias("k"))

    def side(name: str, mark: str) -> DataFrame:
        flips = F.broadcast(_flip_table(hashed.sparkSession, bands, name))
        copies = keyed.select("rep", "size", "n", "one", "k.band", "k.bits").join(flips, "band")
        return copies.select("size", "n", "band", F.col("bits").bitwiseXOR(F.col("flip")).alias("key"), F.col("rep").alias(mark), F.col("one").alias(f"{mark}_one"))

    near = (F.col("a") < F.col("b")) & (hamming(F.col("a_one"), F.col("b_one")) <= reach)
    met = side("left", "a").join(side("right", "b"), ["size", "n", "band", "key"]).where(near).select("a", "b").distinct()
    own = lambda mark: classes.select(F.col("rep").alias(mark), F.col("h").alias(f"{mark}_h"))
    both = met.join(own("a"), "a").join(own("b"), "b")
    return both.select("a", "b", mean_distance("a_h", "b_h").alias("distance")).where(F.col("distance") <= threshold)


def class_links(hashed: DataFrame, id_col: str = "id", hashes: str = "hashes") -> DataFrame:
    """(a, b): every row tied to the smallest id of the rows with the same hashes."""
    usable = hashed.where(F.col(hashes).isNotNull() & F.forall(hashes, lambda h: h.isNotNull()) & (F.size(hashes) > 0))
    least = usable.groupBy(F.col(hashes).alias("_h")).agg(F.min(id_col).alias("a"), F.count("*").alias("n")).where("n > 1")
    return usable.join(least, F.col(hashes) == F.col("_h")).select("a", F.col(id_col).alias("b")).where("a <> b")


def _components(hashed: DataFrame, pairs: DataFrame, same: DataFrame, id_col: str) -> DataFrame:
    """(id, component) of every row; rows by themselves included."""
    found = connected_components(pairs.select("a", "b").unionByName(same), "a", "b")
    return hashed.select(F.col(id_col).alias("id")).join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))


def duplicate_groups(hashed: DataFrame, threshold: int, id_col: str = "id", hashes: str = "hashes") -> DataFrame:
    """(id, component, group_id): components of near pairs, numbered by their smallest member; rows by themselves included."""
    hashed = cut(hashed.select(id_col, hashes))
    named = _components(hashed, near_pairs(hashed, threshold, id_col, hashes), class_links(hashed, id_col, hashes), id_col)
    roots = named.select("component").distinct()
    return named.join(numbered(roots, "component", "number"), "component").select("id", "component", group_name(F.col("number")).alias("group_id"))


def threshold_sensitivity(hashed: DataFrame, thresholds: list[int], id_col: str = "id", hashes: str = "hashes") -> DataFrame:
    """(threshold, groups, grouped): components of more than one row, and the rows in them, for each threshold. Pairs are
    found once, at the largest threshold."""
    hashed = cut(hashed.select(id_col, hashes))
    pairs, same = cut(near_pairs(hashed, max(thresholds), id_col, hashes)), cut(class_links(hashed, id_col, hashes))
    out = None
    for t in thresholds:
        sizes = _components(hashed, pairs.where(F.col("distance") <= t), same, id_col).groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
        row = sizes.agg(F.lit(t).alias("threshold"), F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("grouped"))
        out = row if out is None else out.unionByName(row)
    return out
