"""Embedding near-duplicates by collision-counting projections (operator 3).

Every unit vector is projected on families of random directions. In each family it takes part in the one-dimensional
projection along which it lies furthest out; sorted there, near vectors stand within a window around its value and
collide with it. Pairs that collide in at least as many families as vectors at the threshold do with the wanted recall
are compared exactly.

Counting every pair that collides anywhere would cost a fixed share of all pairs. Families are dealt to small groups,
and vectors meet where they share the projections of two families of a group, of which there are 4 * directions ** 2; a
pair with many collisions has two of them in one group. The number of directions grows with the square root of the rows,
which keeps such meetings per vector bounded.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm.groups import in_blocks, in_cells, runs, spanning
from cadence.llm.vectors import cosines, matrix, usable
from cadence.operators.graph import connected_components
from cadence.session import bound_arrow, cut

#: Pairs that are counted at a time.
PAIRS = 1 << 15
#: More than the widest spread of values in a cell, so that cells stay apart when they are sorted together.
APART = 64.0


@dataclass(frozen=True)
class Projections:
    """`families` of `directions` each, more for many rows, in groups of `group`; windows reach `window` to both sides of
    a value. At a cosine of just `cosine` the count keeps `recall`, and with 48 families a pair has no meeting with a
    probability of about 5e-4. Cells hold about two times `cell` vectors at most."""

    cosine: float = 0.9
    families: int = 48
    group: int = 4
    directions: int = 512
    window: float = 0.8
    recall: float = 0.998
    cell: int = 1024
    seed: int = 3


def sized(p: Projections, rows: int) -> Projections:
    """As many directions, in powers of two, as make four projections of two families for each row, `p.directions` at
    least; the count of collisions is calibrated for them."""
    want = max(p.directions, 1 << max(0, math.ceil(math.log2(max(1, rows)) / 2)))
    return replace(p, directions=want)


def _normals(seed: tuple[int, ...], *shape: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal(shape, np.float32)


def _furthest(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The end (2j for the upper, 2j + 1 for the lower end of projection j) at which each row lies furthest out, and how far."""
    best = np.abs(v).argmax(1)
    value = v[np.arange(len(v)), best]
    return (2 * best + (value < 0)).astype(np.int32), np.abs(value)


@functools.lru_cache(maxsize=8)
def calibrate(p: Projections, trials: int = 1 << 16) -> tuple[float, int]:
    """The probability that a pair at the threshold collides in a family, and the least count that keeps the recall.

    Projections of two unit vectors along random directions are correlated normals, whatever the vectors, so trials with
    such normals give the probability; collisions in independent families are binomial."""
    r, met, step = p.cosine, 0, max(1, (1 << 20) // p.directions)
    for k in range(0, trials, step):
        n = min(step, trials - k)
        x, other = _normals((p.seed, 1, k), n, p.directions), _normals((p.seed, 2, k), n, p.directions)
        (a, u), (b, v) = _furthest(x), _furthest(np.float32(r) * x + np.float32(math.sqrt(1 - r * r)) * other)
        met += int(((a == b) & (np.abs(u - v) <= p.window)).sum())
    each = met / trials
    missed, term, count = 0.0, (1 - each) ** p.families, 0
    while count < p.families and missed + term <= 1 - p.recall:
        missed += term
        term *= (p.families - count) / (count + 1) * each / (1 - each)
        count += 1
    if count < 2:
        raise ValueError("too few families for the wanted recall")
    return each, count


@functools.lru_cache(maxsize=8)
def meetings(p: Projections) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of families in which vectors meet: all within each group."""
    pairs = [(a, b) for g in range(0, p.families, p.group) for a in range(g, min(g + p.group, p.families)) for b in range(a + 1, min(g + p.group, p.families))]
    return tuple(np.array(c, np.int64) for c in zip(*pairs, strict=True))


def places(p: Projections, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, families) of the end at which each vector lies furthest out in each family, and its value there."""
    unit = (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)
    ends, values = np.empty((len(x), p.families), np.int32), np.empty((len(x), p.families), np.float32)
    for f in range(p.families):
        directions = _directions(p.seed, x.shape[1], f, p.directions)
        for k in range(0, len(x), 4096):
            ends[k : k + 4096, f], values[k : k + 4096, f] = _furthest(unit[k : k + 4096] @ directions)
    return ends, values


@functools.lru_cache(maxsize=128)
def _directions(seed: int, dim: int, family: int, count: int) -> np.ndarray:
    return _normals((seed, dim, family), dim, count)


def _placed(p: Projections):
    first, second = meetings(p)
    width = 2 * p.directions

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            ends, values = np.empty((b.num_rows, p.families), np.int32), np.empty((b.num_rows, p.families), np.float32)
            for dim in np.unique(sizes):
                pick = np.flatnonzero(sizes == dim)
                ends[pick], values[pick] = places(p, matrix(b.column(2).take(pa.array(pick))))
            met = ((sizes[:, None].astype(np.int64) * len(first) + np.arange(len(first))) * width + ends[:, first]) * width + ends[:, second]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * m.shape[1], pa.int32()), pa.array(m.ravel())) for m in (ends, values, met)]
            yield pa.RecordBatch.from_arrays([*b.columns, *lists], [*b.schema.names, "ends", "values", "met"])

    return found


def window_pairs(cell: np.ndarray, value: np.ndarray, window: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one cell whose values differ by at most `window`, in bounded lots: rows are sorted by value and each
    is paired with those that follow within its window."""
    key = cell * APART + value
    order = np.argsort(key, kind="stable")
    key = key[order]
    ahead = np.searchsorted(key, key + window, side="right") - np.arange(len(key)) - 1
    total = np.concatenate([[0], np.cumsum(ahead)])
    for k in range(0, int(total[-1]), PAIRS):
        number = np.arange(k, min(k + PAIRS, int(total[-1])))
        i = np.searchsorted(total, number, side="right") - 1
        yield order[i], order[i + 1 + number - total[i]]


def _judged(p: Projections, x: np.ndarray, ends: np.ndarray, values: np.ndarray, cell: np.ndarray, meeting: np.ndarray, apart: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """Linked pairs of rows that meet in a cell and nowhere earlier; rows of one side of an `apart` cell aren't paired.
    Also how many pairs stood in windows, and how many had enough collisions."""
    _, least = calibrate(p)
    first, second = meetings(p)
    unit = (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)
    out, tally = [], {"windows": 0, "counted": 0}
    own = values[np.arange(len(cell)), first[meeting]].astype(np.float64)
    for i, j in window_pairs(cell, own, p.window):
        good = ~apart[i] | (side[i] != side[j])
        i, j = i[good], j[good]
        tally["windows"] += len(i)
        met = (ends[i] == ends[j]) & (np.abs(values[i] - values[j]) <= p.window)
        good = met.sum(1) >= least
        i, j, met = i[good], j[good], met[good]
        good = (met[:, first] & met[:, second]).argmax(1) == meeting[i]
        i, j = i[good], j[good]
        tally["counted"] += len(i)
        good = (unit[i] * unit[j]).sum(1) >= p.cosine - 1e-3
        i, j = i[good], j[good]
        good = cosines(x[i], x[j]) >= p.cosine
        out.append((i[good], j[good]))
    none = np.zeros(0, np.int64)
    i, j = (np.concatenate([none, *c]) for c in zip(*out, strict=True)) if out else (none, none)
    return i, j, tally


def _cells(p: Projections):
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, ["bucket", "one", "two"]):
            table = table.combine_chunks()
            get = lambda c: table.column(c).to_numpy()  # noqa: B023, E731
            ends, values = (table.column(c).combine_chunks().flatten().to_numpy().reshape(table.num_rows, p.families) for c in ("ends", "values"))
            cell = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
            dim, meeting = np.divmod(get("bucket") // (2 * p.directions) ** 2, len(meetings(p)[0]))
            rows = []
            for d in np.unique(dim):
                pick = np.flatnonzero(dim == d)
                x = matrix(table.column("embedding").combine_chunks().take(pa.array(pick)))
                i, j, _ = _judged(p, x, ends[pick], values[pick], cell[pick], meeting[pick], (get("one") != get("two"))[pick], get("side")[pick])
                if not len(i):
                    continue
                cid, weight = get("cid")[pick], get("weight")[pick]
                names, place = np.unique(np.concatenate([cid[i], cid[j]]), return_inverse=True)
                gain = np.zeros(len(names), np.int64)
                np.add.at(gain, place, np.concatenate([weight[j], weight[i]]))
                node, root = spanning(cid[i], cid[j])
                top = names.copy()
                top[np.searchsorted(names, node)] = root
                rows.append((names, top, gain))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], ["a", "b", "links"])

    return judged


def near_duplicates(vectors: DataFrame, p: Projections = Projections()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; links are pairs found with cosine >= p.cosine.

    Equal vectors are collapsed to one first, with the number of their rows. A pair is judged at the first meeting at which
    it collides and nowhere else, so links are counted where they are found and no pair is ever a row: a lot of cells gives
    each of its vectors the number of its links and one edge towards a spanning tree. Meetings of one vector alone are
    left out before vectors travel; those of many are split into cells of about bounded size.

    Vectors that are null, empty or zero or have null or non-finite components, and rows without vec_id, link with
    nothing; vectors link only with those of their length; a pair at just the threshold is linked; each row counts, also
    of a repeated vec_id; other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    bound_arrow(spark)
    single = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    own = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast(single).alias("embedding"))
    p = sized(p, own.count())
    fine = own.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).withColumn("hash", F.xxhash64("embedding"))
    classes = fine.groupBy("hash", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    classes = classes.select(F.monotonically_increasing_id().alias("cid"), "weight", "embedding", "rep", "hash")
    schema = f"cid long, weight long, embedding {single}, rep long, hash long, ends array<int>, values array<float>, met array<long>"
    table = cut(classes.mapInArrow(_placed(p), schema))
    placed = in_blocks(table.select("cid", F.explode("met").alias("bucket")), ["bucket"], "cid", F.lit(1), p.cell)
    full = placed.join(table.select("cid", "weight", "embedding", "ends", "values"), "cid")
    found = cut(in_cells(full, ["bucket"]).mapInArrow(_cells(p), "a long, b long, links long"))
    counts = found.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("a <> b"), "a", "b").withColumnRenamed("node", "cid")
    named = table.select("cid", "hash", "embedding", "rep", "weight").join(counts, "cid", "left").join(groups, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("hash", F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    good = fine.join(named, (fine["hash"] == named["hash"]) & (fine["embedding"] == named["e"])).select("vec_id", "n_links", "component_id")
    rest = own.where(~(F.col("vec_id").isNotNull() & usable(F.col("embedding")))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_collision_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
m AS (SELECT a, min(c) AS c FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(m.c, vec_id) AS component_id, coalesce(m.c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
