"""Gradient-boosted trees from histograms, trained where the rows are (M1).

Rows stay in blocks of binned features. A pass sums, in each task, gradients and curvatures by (class, tree node, feature,
bin); the sums meet by node and group of features, where the best split is found, and the driver gets a row for each. Trees
grow best first: a pass makes the histograms of all nodes that may be split next, and a node is split only when no other
leaf has a larger gain, so the trees are those of splitting one leaf at a time. The driver holds bin edges and trees.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.session import bound_arrow, cut

MISSING = 255
BLOCK_ROWS, GROUP = 4096, 32
SPLIT = "slot int, gain double, feature int, bin int, missing_left boolean, gl double, hl double, nl double, gr double, hr double, nr double"
BLOCKS = "block long, n int, y binary, w binary, held binary, bins binary, raw binary"


@dataclass(frozen=True)
class Boosting:
    """Up to `rounds` trees a class, each of `leaves` leaves at most. A share of `held_out` rows, by a hash of their key,
    is not learnt from; training ends when their loss has not fallen by `tolerance` for `patience` rounds. `bin_rows` rows
    of the smallest hash set the bin edges. `pass_bytes` bounds the histograms of a task; `keep_every` rounds the scores so
    far are stored with the rows."""

    rounds: int = 300
    rate: float = 0.1
    leaves: int = 31
    l2: float = 1.0
    least_rows: int = 20
    least_curvature: float = 1e-3
    balanced: bool = True
    held_out: float = 0.15
    patience: int = 10
    tolerance: float = 1e-7
    bin_rows: int = 20_000
    pass_bytes: int = 256 << 20
    keep_every: int = 10


@dataclass
class Tree:
    """Nodes by number, the root 1 and the children of i 2 i and 2 i + 1: splits (feature, bin, threshold, missing left)
    and leaf values."""

    splits: dict[int, tuple[int, int, float, bool]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def reached(self, n: int, goes_left) -> np.ndarray:
        """The last node of each of n rows; goes_left(rows, split) tells which go left."""
        node = np.ones(n, np.int64)
        todo = [(1, np.arange(n))]
        while todo:
            i, rows = todo.pop()
            if i not in self.splits or not len(rows):
                node[rows] = i
                continue
            down = goes_left(rows, self.splits[i])
            todo += [(2 * i, rows[down]), (2 * i + 1, rows[~down])]
        return node

    def over_bins(self, bins: np.ndarray) -> np.ndarray:
        return self.reached(len(bins), lambda rows, s: np.where(bins[rows, s[0]] == MISSING, s[3], bins[rows, s[0]] <= s[1]))

    def over_values(self, x: np.ndarray) -> np.ndarray:
        return self.reached(len(x), lambda rows, s: np.where(np.isnan(x[rows, s[0]]), s[3], x[rows, s[0]] <= s[2]))

    def of(self, nodes: np.ndarray) -> np.ndarray:
        found, place = np.unique(nodes, return_inverse=True)
        return np.array([self.values[int(i)] for i in found])[place] if len(found) else np.zeros(0)


@dataclass
class Model:
    labels: list
    prior: list[float]
    rounds: list[list[Tree]]
    losses: list[float]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(np.array(self.prior), (len(x), 1))
        for trees in self.rounds:
            for k, t in enumerate(trees):
                out[:, k] += t.of(t.over_values(x))
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the labels, rows of features in."""
        return softmax(self.raw(np.asarray(x, float).reshape(len(x), -1)))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Model:
        d = json.loads(text)
        whole = lambda t: Tree({int(k): tuple(v) for k, v in t["splits"].items()}, {int(k): v for k, v in t["values"].items()})
        return cls(d["labels"], d["prior"], [[whole(t) for t in trees] for trees in d["rounds"]], d["losses"])


def softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def bin_edges(x: np.ndarray, most: int = MISSING - 1) -> np.ndarray:
    """Upper edges between at most `most` + 1 bins of one feature: midpoints of neighbouring values, or of quantiles."""
    v = np.unique(x[~np.isnan(x)])
    if len(v) > most + 1:
        v = np.unique(np.quantile(np.sort(x[~np.isnan(x)]), np.linspace(0, 1, most + 1), method="nearest"))
    return (v[:-1] + v[1:]) / 2


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for f, e in enumerate(edges):
        out[:, f] = np.where(np.isnan(x[:, f]), MISSING, np.searchsorted(e, x[:, f], "left"))
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, width) if len(flat) else np.zeros((0, width))
    return np.where(np.isfinite(x), x, np.nan)


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, o: Boosting) -> tuple[float, int, int, bool, float, float, float, float, float, float]:
    """(gain, feature, bin, missing left, and g, h, n of both children) of the largest gain in (features, 256) sums; ties go
    to the first feature, bin, and missing to the right. A gain of 0 or less is no split."""
    total = [a.sum(1)[:, None] for a in (g, h, n)]
    score = lambda a, b: a * a / (b + o.l2)
    gains, sides = [], []
    for missing_left in (False, True):
        left = [np.cumsum(a[:, :MISSING], 1) + (a[:, MISSING:] if missing_left else 0) for a in (g, h, n)]
        right = [t - a for t, a in zip(total, left, strict=True)]
        ok = (left[2] >= o.least_rows) & (right[2] >= o.least_rows) & (left[1] >= o.least_curvature) & (right[1] >= o.least_curvature)
        gains.append(np.where(ok, score(left[0], left[1]) + score(right[0], right[1]) - score(total[0], total[1]), -np.inf))
        sides.append((*left, *right))
    gain = np.stack(gains, 2)
    f, b, k = (int(i) for i in np.unravel_index(gain.argmax(), gain.shape))
    if not gain[f, b, k] > 0:
        return (0.0, -1, -1, False, *[0.0] * 6)
    return (float(gain[f, b, k]), f, b, bool(k), *(float(a[f, b]) for a in sides[k]))


def _blocks(rows: DataFrame, features: str, label: str, key: str, labels: list, weights: np.ndarray, prior: np.ndarray, edges: list[np.ndarray], o: Boosting) -> DataFrame:
    """The rows as blocks of bins, with their classes, weights, whether they are held out, and scores."""
    place, width, scale = {v: k for k, v in enumerate(labels)}, len(edges), 1 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 33, 0
        for b in batches:
            for i in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(i, BLOCK_ROWS)
                y = np.array([place[v] for v in part.column(1).to_pylist()], np.int32)
                held = part.column(2).to_numpy() < o.held_out * scale
                raw = np.tile(prior, (len(y), 1))
                row = [base + made, len(y), y.tobytes(), weights[y].tobytes(), held.tobytes(), binned(_matrix(part.column(0), width), edges).tobytes(), raw.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int32(), *[pa.binary()] * 5), strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])
                made += 1

    own = rows.select(F.col(features).cast("array<double>").alias("x"), F.col(label).alias("y"), F.pmod(F.xxhash64(key, F.lit(11)), F.lit(scale)).alias("h"))
    return cut(own.mapInArrow(run, BLOCKS))


def _open(row: dict, width: int, classes: int) -> tuple[np.ndarray, ...]:
    n = row["n"]
    return np.frombuffer(row["y"], np.int32), np.frombuffer(row["w"]), np.frombuffer(row["held"], bool), np.frombuffer(row["bins"], np.uint8).reshape(n, width), np.frombuffer(row["raw"]).reshape(n, classes)


def _with_trees(raw: np.ndarray, bins: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    raw = raw.copy()
    for trees in rounds:
        for k, t in enumerate(trees):
            raw[:, k] += t.of(t.over_bins(bins))
    return raw


def _histograms(blocks: DataFrame, width: int, classes: int, rounds: list[list[Tree]], grown: list[Tree], slots: list[tuple[int, int]], o: Boosting) -> tuple[dict[int, tuple], float]:
    """The best split of each slot (class, node), and the mean loss of the rows held out."""
    groups = range(0, width, GROUP)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(slots), width, 256, 3))
        loss = np.zeros(2)
        for b in batches:
            for row in b.to_pylist():
                y, w, held, bins, raw = _open(row, width, classes)
                p = softmax(_with_trees(raw, bins, rounds))
                loss += [-(w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)))[held].sum(), w[held].sum()]
                nodes = {k: grown[k].over_bins(bins) for k in {k for k, _ in slots}}
                for s, (k, node) in enumerate(slots):
                    at = np.flatnonzero((nodes[k] == node) & ~held)
                    g = w[at] * (p[at, k] - (y[at] == k))
                    h = w[at] * p[at, k] * (1 - p[at, k])
                    for f in range(width if len(at) else 0):
                        c = bins[at, f]
                        for j, v in enumerate((g, h, None)):
                            total[s, f, :, j] += np.bincount(c, v, 256)
        part = TaskContext.get().partitionId()
        out = [(s, f, part, total[s, f : f + GROUP].tobytes()) for s in range(len(slots)) for f in groups] + [(-1, 0, part, loss.tobytes())]
        for i in range(0, len(out), 16):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 16], strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["slot", "first", "part", "data"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, out = None, None, []

        def done():
            slot, first = now
            if slot < 0:
                out.append((slot, float(total[0] / max(total[1], 1e-300)), *[0] * 2, False, *[0.0] * 6))
                return
            a = total.reshape(-1, 256, 3)
            gain, f, b, left, *rest = best_split(a[..., 0], a[..., 1], a[..., 2], o)
            # Without a split the sums of the node itself, which any feature gives.
            rest = rest if f >= 0 else [*a[0].sum(0), 0.0, 0.0, 0.0]
            out.append((slot, gain, first + f if f >= 0 else -1, b, left, *map(float, rest)))

        for batch in batches:
            for r in batch.to_pylist():
                if (r["slot"], r["first"]) != now:
                    if now is not None:
                        done()
                    now, total = (r["slot"], r["first"]), 0.0
                # In order of the parts, so that a rerun adds up the same way.
                total = total + np.frombuffer(r["data"])
        if now is not None:
            done()
        names = [c.split()[0] for c in SPLIT.split(", ")]
        kinds = [pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.float64()] * 6]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    parts = blocks.mapInArrow(sums, "slot int, first int, part int, data binary")
    rows = parts.repartition("slot", "first").sortWithinPartitions("slot", "first", "part").mapInArrow(best, SPLIT).collect()
    found: dict[int, tuple] = {}
    loss = 0.0
    for r in sorted(rows, key=lambda r: (r.slot, -r.gain, r.feature)):
        if r.slot < 0:
            loss = r.gain
        else:
            found.setdefault(r.slot, tuple(r[1:]))
    return found, loss


@dataclass
class _Growing:
    """One tree on its way: what is known of nodes, and which ones have children to look at."""

    known: dict[int, tuple] = field(default_factory=dict)
    opened: set[int] = field(default_factory=set)

    def chosen(self, o: Boosting) -> tuple[list[int], list[int]]:
        """Nodes split so far, best first, and leaves whose children must be seen next, the most urgent first."""
        if 1 not in self.known:
            return [], []
        heap, split = [(-self.known[1][0], 1)], []
        while heap and len(split) < o.leaves - 1 and -heap[0][0] > 0:
            _, node = heap[0]
            if node not in self.opened:
                return split, [i for g, i in sorted(heap)[: o.leaves - 1 - len(split)] if g < 0 and i not in self.opened]
            heapq.heappop(heap)
            split.append(node)
            for child in (2 * node, 2 * node + 1):
                if child in self.known:
                    heapq.heappush(heap, (-self.known[child][0], child))
        return split, []

    def tree(self, nodes: list[int] | set[int], edges: list[np.ndarray], o: Boosting) -> Tree:
        t = Tree()
        for i in nodes:
            _, f, b, left, *_ = self.known[i]
            t.splits[i] = (f, b, float(edges[f][b]) if b < len(edges[f]) else float("inf"), left)
        if not t.splits:
            g, h = self.known[1][4:6] if 1 in self.known else (0.0, 0.0)
            t.values[1] = -o.rate * g / (h + o.l2) if 1 in self.known and self.known[1][1] < 0 else 0.0
        for i in t.splits:
            gl, hl, _, gr, hr, _ = self.known[i][4:]
            for child, g, h in ((2 * i, gl, hl), (2 * i + 1, gr, hr)):
                if child not in t.splits:
                    t.values[child] = -o.rate * g / (h + o.l2)
        return t


def train(rows: DataFrame, features: str, label: str, key: str, o: Boosting = Boosting()) -> Model:
    """Boosted trees on rows with `features` (arrays of one width; missing or infinite entries go where they fit best) and
    `label`; rows without either take no part. Reruns give the same model. The driver holds the labels (10,000 at most),
    `bin_rows` rows for the edges, and a row for each node and group of features of a pass."""
    spark = rows.sparkSession
    bound_arrow(spark)
    own = rows.where(F.col(features).isNotNull() & F.col(label).isNotNull())
    counts = own.groupBy(label).count().limit(10_001).collect()
    if not counts or len(counts) > 10_000:
        raise ValueError(f"boosting needs between 1 and 10,000 labels, not {len(counts)}")
    labels = sorted(r[0] for r in counts)
    n = np.array([dict((r[0], r[1]) for r in counts)[v] for v in labels], float)
    weights = n.sum() / (len(n) * n) if o.balanced else np.ones(len(n))
    prior = np.log(n * weights / (n * weights).sum())
    sample = own.select(F.col(features).cast("array<double>").alias("x"), F.xxhash64(key, F.lit(7)).alias("h")).orderBy("h", "x").limit(o.bin_rows).collect()
    seen = np.array([[np.nan if v is None or not np.isfinite(v) else v for v in r.x] for r in sample], float)
    edges = [bin_edges(seen[:, f]) for f in range(seen.shape[1])]
    width, classes = len(edges), len(labels)
    blocks = _blocks(own, features, label, key, labels, weights, prior, edges, o)
    most = max(classes, o.pass_bytes // (width * 256 * 24))
    model, since = Model(labels, prior.tolist(), [], []), 0
    for number in range(o.rounds):
        growing = [_Growing() for _ in labels]
        wanted: list[tuple[int, int]] = [(k, 1) for k in range(classes)]
        first = True
        while wanted:
            slots, wanted = wanted[:most], wanted[most:]
            grown = [t.tree(t.opened, edges, o) for t in growing]
            found, loss = _histograms(blocks, width, classes, model.rounds[since:], grown, slots, o)
            if first:
                model.losses.append(loss)
                first = False
            for s, (k, node) in enumerate(slots):
                growing[k].known[node] = found[s]
            if not wanted:
                for k, t in enumerate(growing):
                    for i in t.chosen(o)[1]:
                        t.opened.add(i)
                        wanted += [(k, 2 * i), (k, 2 * i + 1)]
        if o.held_out and number >= o.patience and min(model.losses[-o.patience :]) > min(model.losses[: -o.patience]) - o.tolerance:
            break
        model.rounds.append([t.tree(t.chosen(o)[0], edges, o) for t in growing])
        if len(model.rounds) - since >= o.keep_every:
            blocks, since = _scored(blocks, width, classes, model.rounds[since:]), len(model.rounds)
    return model


def _scored(blocks: DataFrame, width: int, classes: int, rounds: list[list[Tree]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [_with_trees(r, bins, rounds).tobytes() for *_, bins, r in (_open(row, width, classes) for row in b.to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(raw, pa.binary())], b.schema.names)

    return cut(blocks.mapInArrow(run, BLOCKS))


def predict(rows: DataFrame, features: str, model: Model) -> DataFrame:
    """The rows with `probabilities` in the order of the model's labels and the most likely `predicted` label (the first of
    equal ones); NULL for rows without features."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def score(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in frames:
            known = x.notna()
            m = np.array([[np.nan if v is None or not np.isfinite(v) else v for v in r] for r in x[known]], float)
            found = iter(shared.value(m) if len(m) else ())
            yield pd.Series([next(found) if k else None for k in known], index=x.index, dtype=object)

    kind = rows.sparkSession.createDataFrame([(v,) for v in model.labels[:1]], ["v"]).schema["v"].dataType
    names = F.array(*[F.lit(v).cast(kind) for v in model.labels])
    out = rows.withColumn("probabilities", score(F.col(features).cast("array<double>")))
    return out.withColumn("predicted", F.get(names, (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int")))

