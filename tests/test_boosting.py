"""Boosted trees: split gains and whole trees against loops over rows, and the same model from any partitioning."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.operators.boosting import MISSING, Boosting, Model, best_split, bin_edges, binned, predict, softmax, train
from tests.conftest import SF


def brute_split(x, g, h, o):
    """(gain, feature, bin, missing left) by trying every split of rows of bins."""
    score = lambda a, b: a * a / (b + o.l2)
    best = (0.0, -1, -1, False)
    for f in range(x.shape[1]):
        for b in range(MISSING):
            for m in (False, True):
                left = np.where(x[:, f] == MISSING, m, x[:, f] <= b)
                if min(left.sum(), (~left).sum()) < o.least_rows or min(h[left].sum(), h[~left].sum()) < o.least_curvature:
                    continue
                gain = score(g[left].sum(), h[left].sum()) + score(g[~left].sum(), h[~left].sum()) - score(g.sum(), h.sum())
                if gain > best[0] + 1e-9:
                    best = (gain, f, b, m)
    return best


def brute_train(x, y, classes, o):
    """One leaf at a time, always the one of the largest gain; every split by `brute_split`."""
    n = np.bincount(y, minlength=classes)
    w = (len(y) / (classes * n))[y] if o.balanced else np.ones(len(y))
    edges = [bin_edges(x[:, f]) for f in range(x.shape[1])]
    bins = binned(x, edges)
    mass = np.array([w[y == k].sum() for k in range(classes)])
    raw = np.tile(np.log(mass / mass.sum()), (len(y), 1))
    shapes = []
    for _ in range(o.rounds):
        p, step = softmax(raw), np.zeros_like(raw)
        for k in range(classes):
            g, h = w * (p[:, k] - (y == k)), w * p[:, k] * (1 - p[:, k])
            leaves = {1: np.arange(len(y))}
            known = {1: brute_split(bins, g, h, o)}
            splits = {}
            while len(leaves) < o.leaves:
                i = max(leaves, key=lambda i: (known[i][0], -i))
                gain, f, b, m = known[i]
                if gain <= 0:
                    break
                rows = leaves.pop(i)
                left = np.where(bins[rows, f] == MISSING, m, bins[rows, f] <= b)
                splits[i] = (f, b, bool(m))
                for c, part in ((2 * i, rows[left]), (2 * i + 1, rows[~left])):
                    leaves[c], known[c] = part, brute_split(bins[part], g[part], h[part], o)
            for rows in leaves.values():
                step[rows, k] = -o.rate * g[rows].sum() / (h[rows].sum() + o.l2)
            shapes.append(splits)
        raw = raw + step
    return shapes, raw


def table(spark, x, y, parts):
    rows = [(i, [None if math.isnan(v) else float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, x array<double>, y int").repartition(parts)


def sample(n=220, seed=4):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = np.round(rng.normal(size=(n, 5)) + np.stack([y, y == 1, np.zeros(n), y * 0.3, np.zeros(n)], 1), 1)
    x[rng.random((n, 5)) < 0.1] = np.nan
    return x, y


def test_splits():
    rng = np.random.default_rng(1)
    for t in range(6):
        bins = rng.integers(0, 6, (80, 4)).astype(np.uint8)
        bins[rng.random((80, 4)) < 0.15] = MISSING
        g, h = rng.normal(size=80), rng.random(80)
        o = Boosting(least_rows=5 + t)
        sums = np.zeros((4, 256, 3))
        for f in range(4):
            for j, v in enumerate((g, h, None)):
                sums[f, :, j] = np.bincount(bins[:, f], v, 256)
        got, want = best_split(*np.moveaxis(sums, 2, 0), o), brute_split(bins, g, h, o)
        assert got[1:4] == want[1:4] and abs(got[0] - want[0]) < 1e-9


def test_trees_are_those_of_one_leaf_at_a_time(spark):
    x, y = sample()
    o = Boosting(rounds=3, leaves=6, least_rows=8, held_out=0.0, keep_every=2, pass_bytes=0)
    want, raw = brute_train(x, y, 3, o)
    for parts in (1, 3):
        model = train(table(spark, x, y, parts), "x", "y", "id", o)
        got = [{i: (f, b, m) for i, (f, b, _, m) in t.splits.items()} for trees in model.rounds for t in trees]
        assert got == want and max(len(s) for s in want) == 5
        assert np.abs(model.raw(x) - raw).max() < 1e-9


def test_same_model_again_and_its_document(spark):
    x, y = sample(900, 2)
    o = Boosting(rounds=6, leaves=8, least_rows=5, patience=3)
    df = table(spark, x, y, 3)
    one, two = train(df, "x", "y", "id", o), train(df, "x", "y", "id", o)
    assert one.to_json() == two.to_json() and len(one.losses) >= 4 and one.losses[-1] < one.losses[0]
    back = Model.from_json(one.to_json())
    assert np.array_equal(back(x), one(x))
    odd = spark.createDataFrame([(1, [0.5, None, float("nan"), float("inf"), 1.0]), (2, None)], "id long, x array<double>")
    rows = {r.id: r for r in predict(odd, "x", back).collect()}
    assert rows[2].predicted is None and rows[2].probabilities is None and abs(sum(rows[1].probabilities) - 1) < 1e-12
    right = predict(df, "x", back).where(F.col("predicted") == F.col("y")).count()
    assert right > 0.6 * 900


def test_stops_early_and_knows_its_limits(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(400, 3)), rng.integers(0, 2, 400)
    model = train(table(spark, x, y, 2), "x", "y", "id", Boosting(rounds=30, leaves=4, patience=2, held_out=0.3))
    assert len(model.rounds) < 30
    alone = train(table(spark, x, np.zeros(400, int), 2), "x", "y", "id", Boosting(rounds=1, held_out=0.0))
    assert alone.labels == [0] and np.allclose(alone(x), 1)
    with pytest.raises(ValueError, match="labels"):
        train(table(spark, x[:0], y[:0], 1), "x", "y", "id")


def test_vectors_of_the_tables(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", (F.get("embedding", F.lit(0)) + F.get("embedding", F.lit(1)) > 0).cast("int").alias("y"))
    model = train(e, "embedding", "y", "vec_id", Boosting(rounds=12, leaves=8, held_out=0.0))
    assert predict(e, "embedding", model).where("predicted = y").count() > 470
