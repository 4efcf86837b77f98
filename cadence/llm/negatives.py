"""Hard negatives by exact inner products, found along one-dimensional distance keys (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.session import bound_arrow, cut, shuffle_width

ROWS = "pivot int, dist double, tie long, vec_id long, label long, vec binary"
BLOCKS = "block long, pivot int, lo double, hi double, n int, ids binary, labels binary, vecs binary, width int"
TARGETS = "anchor_id long, part int, label long, same boolean, low long, high long, vec binary, bound long, before long"
SPANS = "anchor_id long, part int, pivot int, cell int, dq double, frm double, til double, home_frm double, home_til double, seen double, near double"
FOUND = "anchor_id long, part int, vec_id long, score long"
LEAST, MOST = -(2**63), 2**63 - 1


@dataclass(frozen=True)
class Keys:
    """Parameters of the index: `pivots` rows of the smallest hash serve as pivots, a block holds at most `rows` vectors
    and about `block_bytes`, keys fall into `cells` equal cells, a task part of a block meets at most `visitors` targets
    on average, and `steps` are the shares of the certified radius that are searched one after the other."""

    pivots: int = 16
    rows: int = 2048
    block_bytes: int = 4 << 20
    cells: int = 16
    visitors: int = 2048
    steps: tuple[float, ...] = (0.5, 1.0)


@dataclass(frozen=True)
class Index:
    """Blocks of vectors sorted by (pivot, distance), and what places a target among them."""

    blocks: DataFrame
    pivots: np.ndarray
    top: float
    widest: float
    ranges: dict[int, tuple[float, float]]
    keys: Keys


def components(column: pa.Array, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """floor(256 x) of each component as rows of doubles, short rows filled with zeros, and which rows take part."""
    n, lists = len(column), column
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    bad = flat.is_null().to_numpy(zero_copy_only=False)
    x = np.floor(256.0 * flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64))
    bad |= ~np.isfinite(x)
    row = np.repeat(np.arange(n), lengths)
    use = ~lists.is_null().to_numpy(zero_copy_only=False) & (np.bincount(row[bad], minlength=n) == 0)
    out = np.zeros((n, max(width, int(lengths.max(initial=0)))))
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place] = np.where(bad, 0.0, x)
    return out, use


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of q and x, as longs. Doubles hold them exactly up to 2 ** 53; beyond that
    they are summed as whole numbers of any size, and what a long cannot hold stays at its ends."""
    width = min(q.shape[1], x.shape[1])
    q, x = q[:, :width], x[:, :width]
    if width == 0:
        return np.zeros((len(q), len(x)), np.int64)
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * width < 2.0**53:
        return (q @ x.T).astype(np.int64)
    whole = np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in x], object).T
    return np.clip(whole, LEAST, MOST).astype(np.int64)


def _squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)


def _distances(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray, top: float) -> np.ndarray:
    """Distance of each row of x, lifted by one more coordinate, to each pivot lifted to the sphere of radius sqrt(top)."""
    width = max(x.shape[1], pivots.shape[1])
    x, p = (np.pad(a, ((0, 0), (0, width - a.shape[1]))) for a in (x, pivots))
    raised = np.sqrt(np.maximum(top - _squares(p), 0))
    square = _squares(x)[:, None] + _squares(p)[None] - 2 * x @ p.T + (lift[:, None] - raised[None]) ** 2
    return np.sqrt(np.maximum(square, 0))


def build(vectors: DataFrame, keys: Keys) -> Index | None:
    """The index over (vec_id long, label long, vec array): one pass for the largest norm and the pivots, one sort by
    (pivot, distance). None without rows that take part. The driver holds the pivots and one key range a pivot."""
    spark = vectors.sparkSession
    bound_arrow(spark)

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, use = components(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([int(use.sum())]), pa.array([float(_squares(x[use]).max(initial=0))])], ["n", "top"])

    stats = vectors.select("vec").mapInArrow(norms, "n long, top double").agg(F.sum("n"), F.max("top")).first()
    if not stats[0]:
        return None
    top = float(stats[1])
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    drawn = vectors.where(fine).select("vec", F.xxhash64("vec_id", "vec").alias("h")).orderBy("h").limit(keys.pivots).collect()
    pivots, _ = components(pa.array([r.vec for r in drawn], pa.list_(pa.float64())))
    pivots = np.unique(pivots, axis=0)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, use = components(b.column(3))
            x = x[use]
            d = _distances(x, np.sqrt(np.maximum(top - _squares(x), 0)), pivots, top)
            near = d.argmin(1) if len(x) else np.zeros(0, np.int64)
            vecs = pa.array([r.tobytes() for r in x], pa.binary())
            rest = [b.column(k).filter(pa.array(use)) for k in (2, 0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), pa.array(d[np.arange(len(x)), near]), *rest, vecs], names=[c.split()[0] for c in ROWS.split(", ")])

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.xxhash64("vec_id").alias("tie"), "vec").mapInArrow(keyed, ROWS)
    order = ["pivot", "dist", "tie"]
    most, room = keys.rows, keys.block_bytes

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made, held = TaskContext.get().partitionId() << 33, 0, []
        size = 0

        def block():
            nonlocal held, size, made
            table = pa.Table.from_batches(held)
            dist, vecs = table["dist"].to_numpy(), table["vec"].to_pylist()
            wide = max(map(len, vecs))
            out = [base + made, table["pivot"][0].as_py(), dist[0], dist[-1], len(dist), table["vec_id"].to_numpy().tobytes(), table["label"].to_numpy().tobytes(), b"".join(v.ljust(wide, b"\0") for v in vecs), wide // 8]
            held, size, made = [], 0, made + 1
            return pa.RecordBatch.from_pylist([dict(zip(_names(BLOCKS), out, strict=True))], schema=_arrow(BLOCKS))

        for b in batches:
            while b.num_rows:
                pivot = b.column(0).to_numpy()
                if held and held[0].column(0)[0].as_py() != pivot[0]:
                    yield block()
                lengths = np.cumsum([len(v) for v in b.column(5).to_pylist()])
                take = min(int((pivot == pivot[0]).sum()), most - sum(h.num_rows for h in held), max(1, int(np.searchsorted(lengths, room - size, "right"))))
                held.append(b.slice(0, take))
                size += int(lengths[take - 1])
                b = b.slice(take)
                if sum(h.num_rows for h in held) >= most or size >= room:
                    yield block()
        if held:
            yield block()

    blocks = cut(rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order, "vec_id").mapInArrow(pack, BLOCKS))
    ranges = {r.pivot: (r.lo, r.hi) for r in blocks.groupBy("pivot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}
    return Index(blocks, pivots, top, max(hi for _, hi in ranges.values()), ranges, keys)


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _spans(targets: DataFrame, index: Index, step: int) -> DataFrame:
    """For each target and pivot the key interval of this step, in cells; step 0 is one cell about the target's key at the
    pivot with the largest product, later steps are the annulus of a share of the radius that the bound certifies."""
    keys, pivots, top, widest, ranges = index.keys, index.pivots, index.top, index.widest, index.ranges
    cell = max(widest / keys.cells, 1e-300)
    share = 1.0 if step == 0 else keys.steps[step - 1]
    slack = 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {k: [] for k in _names(SPANS)}
            for t in b.to_pylist():
                q = np.frombuffer(t["vec"])[None]
                dq = _distances(q, np.zeros(1), pivots, top)[0]
                square = float(_squares(q)[0]) + top
                margin = slack * (square + widest**2)
                radius, seen = (np.sqrt(max(0.0, square - 2.0 * v + margin)) if v > LEAST else np.inf for v in (t["bound"], t["before"]))
                radius, seen = radius * share, -np.inf if step < 2 else seen * keys.steps[step - 2]
                near = np.sqrt(max(0.0, square - 2.0 * t["high"] - margin)) if t["high"] < MOST else 0.0
                width = min(q.shape[1], pivots.shape[1])
                home = int(min(ranges, key=lambda p: (-float(q[0, :width] @ pivots[p, :width]), p)))
                middle = min(max(dq[home], ranges[home][0]), ranges[home][1])
                for p, (lo, hi) in ranges.items():
                    own = (middle - cell / 2, middle + cell / 2) if p == home else (np.inf, -np.inf)
                    frm, til = own if step == 0 else (dq[p] - radius, dq[p] + radius)
                    frm, til = max(frm, lo), min(til, hi)
                    if not frm <= til:
                        continue
                    for c in range(int(frm / cell), int(til / cell) + 1):
                        for k, v in zip(out, (t["anchor_id"], t["part"], p, c, dq[p], frm, til, *own, seen, near), strict=True):
                            out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_arrow(SPANS))

    return targets.mapInArrow(run, SPANS)


def _visits(targets: DataFrame, index: Index, step: int) -> DataFrame:
    """(anchor_id, part, block): each block that a target has to see in this step and has not seen, once."""
    cell = F.lit(max(index.widest / index.keys.cells, 1e-300))
    first, last = (F.col("lo") / cell).cast("int"), (F.col("hi") / cell).cast("int")
    places = index.blocks.select("block", "pivot", "lo", "hi", first.alias("first"), F.explode(F.sequence(first, last)).alias("cell"))
    met = _spans(targets, index, step).join(places, ["pivot", "cell"])
    meets = (F.col("lo") <= F.col("til")) & (F.col("hi") >= F.col("frm"))
    once = F.col("cell") == F.greatest("first", (F.col("frm") / cell).cast("int"))
    far_enough = F.col("dq") + F.col("hi") >= F.col("near")
    at_home = (F.col("lo") <= F.col("home_til")) & (F.col("hi") >= F.col("home_frm"))
    earlier = (F.col("lo") <= F.col("dq") + F.col("seen")) & (F.col("hi") >= F.col("dq") - F.col("seen"))
    fresh = F.lit(True) if step == 0 else ~at_home & ~earlier
    return met.where(meets & once & far_enough & fresh).select("anchor_id", "part", "block")


def _scan(visits: DataFrame, targets: DataFrame, index: Index, k: int) -> DataFrame:
    """The k best rows of each visited block for each target: targets travel to blocks, and a block with many visitors
    stands in several parts."""
    loads = visits.groupBy("block").agg(F.ceil(F.count("*") / index.keys.visitors).cast("int").alias("parts"))
    dealt = visits.join(loads, "block").withColumn("salt", F.pmod(F.xxhash64("anchor_id", "part"), F.col("parts")).cast("int"))
    callers = dealt.join(targets.drop("bound", "before"), ["anchor_id", "part"])
    nothing = {c: F.lit(None).cast(kind) for c, kind in (x.split() for x in (TARGETS + ", " + BLOCKS).split(", "))}
    names = [*_names(TARGETS)[:7], *_names(BLOCKS)[4:]]
    halls = index.blocks.join(loads, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def one(df, kind):
        return df.select("block", "salt", F.lit(kind).alias("kind"), *[df[c] if c in df.columns else nothing[c].alias(c) for c in names])

    both = one(halls, 0).unionByName(one(callers, 1)).repartition("block", "salt").sortWithinPartitions("block", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hall = None
        for b in batches:
            out, rows, at = {c: [] for c in _names(FOUND)}, b.to_pylist(), 0
            while at < len(rows):
                r = rows[at]
                if r["kind"] == 0:
                    x = np.frombuffer(r["vecs"]).reshape(r["n"], r["width"])
                    hall = x, np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
                    at += 1
                    continue
                x, ids, labels = hall
                end = at + 1
                while end < len(rows) and end < at + 256 and rows[end]["kind"] == 1 and len(rows[end]["vec"]) == len(r["vec"]):
                    end += 1
                scores = products(np.frombuffer(b"".join(t["vec"] for t in rows[at:end])).reshape(end - at, -1), x)
                for t, own in zip(rows[at:end], scores, strict=True):
                    use = ((labels == t["label"]) == t["same"]) & (own >= t["low"]) & (own <= t["high"]) & (ids != t["anchor_id"])
                    place = np.flatnonzero(use)
                    place = place[np.lexsort((ids[place], ~own[place]))[:k]]
                    for c, v in zip(out, ([t["anchor_id"]] * len(place), [t["part"]] * len(place), ids[place].tolist(), own[place].tolist()), strict=True):
                        out[c] += v
                at = end
            yield pa.RecordBatch.from_pydict(out, schema=_arrow(FOUND))

    return both.mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each target, in order; Spark keeps k rows a target and task before the shuffle."""
    order = Window.partitionBy("anchor_id", "part").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(targets: DataFrame, index: Index, k: int) -> DataFrame:
    """(anchor_id, part, vec_id, score, rank): the k rows of each target (see TARGETS) with the largest products, ties by
    smaller vec_id, among rows of its label (`same`) or of other labels with low <= score <= high.

    A target starts in one cell of keys, takes the k-th score found as bound, and widens its key intervals to a share and
    then to the whole of the radius at which no row outside can reach the bound: by the triangle inequality such a row's
    distance to a pivot lies within that radius of the target's. So the result is exact.
    """
    best = None
    targets = cut(targets)
    for step in range(len(index.keys.steps) + 1):
        found = _scan(cut(_visits(targets, index, step)), targets, index, k)
        best = cut(_best(found if best is None else best.drop("rank").unionByName(found), k))
        if step == len(index.keys.steps):
            break
        bounds = best.where(F.col("rank") == k).select("anchor_id", "part", F.col("score").alias("kth"))
        targets = targets.join(bounds, ["anchor_id", "part"], "left").withColumn("before", F.col("bound")).withColumn("bound", F.greatest("bound", "kth")).drop("kth")
    return best


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), keys: Keys = Keys()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of `anchors` (vec_id) against all
    `vectors` (vec_id, embedding, label).

    Components count as floor(256 x); a score is an integer inner product. Positives are an anchor's best other rows of
    its label; negatives the best rows of other labels whose score is at most the positive's and at least share[0] /
    share[1] of it. Rows with a null vec_id, label or vector or a null or non-finite component take no part; a shorter
    vector ends in zeros, so an empty one has score 0 with all. Ties go to the smaller vec_id. Every row is a candidate,
    repeated or not, except that rows with the anchor's own vec_id are never its positives; of several rows with an
    anchor's vec_id the one with the smallest (label, vector) is the anchor. Scores stay at the ends of a long. Empty
    tables give no rows; other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    bound_arrow(spark)
    named = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    own = vectors.where(named).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    index = build(own, keys)
    if index is None:
        return empty
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    asked = anchors.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    asking = own.where(fine).join(asked, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("row"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, use = components(b.column(2))
            keep = pa.array(use)
            n = int(use.sum())
            fixed = [pa.array([0] * n, pa.int32()), b.column(1).filter(keep), pa.array([True] * n), pa.array([LEAST] * n), pa.array([MOST] * n), pa.array([r.tobytes() for r in x[use]], pa.binary()), pa.array([LEAST] * n), pa.array([LEAST] * n)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), *fixed], schema=_arrow(TARGETS))

    first = cut(asking.select("vec_id", "row.label", "row.vec").mapInArrow(whole, TARGETS))
    same = search(first, index, positives)
    up, down = F.lit(share[0]), F.lit(share[1])
    # The least whole score that is share[0] / share[1] of the positive's, in decimals that no long overflows.
    least = F.ceil(F.col("score").cast("decimal(25,0)") * up / down).cast("long")
    pairs = same.select("anchor_id", F.col("rank").alias("part"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), least.alias("low"), F.col("score").alias("high"))
    pairs = cut(pairs.where("low <= high"))
    second = pairs.join(first.select("anchor_id", "label", "vec"), "anchor_id").withColumns({"same": F.lit(False), "bound": F.col("low"), "before": F.col("low")})
    other = search(second.select(*_names(TARGETS)), index, negatives)
    out = other.join(pairs, ["anchor_id", "part"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_distance_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of `embeddings`: anchors are ids divisible by 100, and labels of ids divisible by 7 move on by one."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", label)
    return hard_negatives(rows, rows.where(F.col("vec_id") % 100 == 0).select("vec_id"))


OP13_SQL = """
WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
        CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
    SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
        AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
