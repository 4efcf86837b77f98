"""Gradients against finite differences, the same training from any number of tasks, and a restart from the stored state."""

from dataclasses import replace

import numpy as np
import pytest

from cadence.operators import temporal
from cadence.operators.models import class_scores
from cadence.operators.temporal import Options, logits, macro_f1, start, step

SMALL = Options(layers=((5, 3, 1), (4, 3, 2), (6, 3, 1)), dropout=0.25, batch=40, epochs=5, patience=5, rate=0.01)


def test_gradients():
    rng = np.random.default_rng(1)
    w, run = start(4, 3, SMALL)
    x, y, weight = rng.normal(size=(7, 9, 4)), rng.integers(0, 3, 7), rng.random(7) + 0.5
    keep = (rng.random((7, 6)) > 0.3) / 0.7
    w = {k: v + rng.normal(size=v.shape) * 0.1 for k, v in w.items()}
    loss = lambda w: step(x, y, weight, weight.sum(), keep, w, run, SMALL, lambda a: np.asarray(a))[0]
    _, g, _ = step(x, y, weight, weight.sum(), keep, w, run, SMALL, lambda a: np.asarray(a))
    for name, v in w.items():
        for i in rng.choice(v.size, min(6, v.size), replace=False):
            low, high = ({k: u.copy() for k, u in w.items()} for _ in range(2))
            low[name].flat[i] -= 1e-5
            high[name].flat[i] += 1e-5
            want = (loss(high) - loss(low)) / 2e-5
            assert abs(g[name].flat[i] - want) < 1e-6 + 1e-4 * abs(want), (name, i)


def test_parts_add_up():
    """A batch split over tasks gives the gradients of the whole one, also where a task has none of its rows."""
    from threading import Barrier, Thread

    rng = np.random.default_rng(2)
    w, run = start(4, 3, SMALL)
    x, y, weight, keep = rng.normal(size=(8, 10, 4)), rng.integers(0, 3, 8), np.ones(8), np.ones((8, 6))
    want = step(x, y, weight, weight.sum(), keep, w, run, SMALL, lambda a: np.asarray(a))
    parts, shared, gate, out = [slice(0, 3), slice(3, 3), slice(3, 8)], [None] * 3, Barrier(3, timeout=20), [None] * 3

    def task(k):
        def total(a):
            shared[k] = np.asarray(a)
            gate.wait()
            s = np.sum(shared, 0)
            gate.wait()
            return s

        p = parts[k]
        out[k] = step(x[p], y[p], weight[p], weight.sum(), keep[p], w, run, SMALL, total)

    threads = [Thread(target=task, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    for got in out:
        assert abs(got[0] - want[0]) < 1e-12 and all(np.allclose(got[1][n], want[1][n], atol=1e-12) for n in want[1])
        assert all(np.allclose(got[2][n], want[2][n], atol=1e-12) for n in run)


def toy(spark, n=240):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        c = i % 3
        x = rng.normal(size=(12, 4)) * 0.4
        x[:, c] += np.sin(np.arange(12) * (c + 1))
        rows.append((i, x.tolist(), "abc"[c], i % 5 == 0))
    return spark.createDataFrame(rows, "id long, rows array<array<double>>, label string, held boolean")


def test_tasks_train_together(spark):
    """Losses do not depend on the number of tasks; the model tells the classes apart and is a plug-in for windows."""
    df = toy(spark)
    o = replace(SMALL, batch=1000, epochs=2, rate=0.05, dropout=0.0)
    one = temporal.train(df, "label", "id", "held", 1, o)
    some = temporal.train(df.repartition(3), "label", "id", "held", 3, o)
    assert len(one.history) == 2 and all(abs(a["loss"] - b["loss"]) < 1e-6 for a, b in zip(one.history, some.history, strict=True))
    assert one.history[-1]["loss"] < one.history[0]["loss"] and some.labels == ["a", "b", "c"]
    scored = class_scores(df, some).select("id", "scores").collect()
    same = {r.id: r.scores for r in class_scores(df, one).select("id", "scores").collect()}
    assert all(np.allclose(r.scores, same[r.id], atol=1e-6) for r in scored) and len(scored) == 240
    with pytest.raises(ValueError, match="labels"):
        temporal.train(df.limit(0), "label", "id", "held", 1, SMALL)


def test_goes_on_from_a_stored_state():
    rng = np.random.default_rng(3)
    rows = (rng.normal(size=(60, 8, 4)).astype(np.float32), rng.integers(0, 2, 60), np.arange(60), np.arange(60) % 4 == 0)
    kept = []
    whole = temporal._fit(rows, 45, np.array([20.0, 25.0]), 4, SMALL, lambda a: np.asarray(a), lambda: None, kept.append)
    again = temporal._fit(rows, 45, np.array([20.0, 25.0]), 4, SMALL, lambda a: np.asarray(a), lambda: kept[1], lambda _: None)
    assert whole["notes"] == again["notes"] and all(np.array_equal(whole[k], again[k]) for k in whole if k != "notes")
    assert logits(rows[0][:0], *start(4, 2, SMALL), SMALL).shape == (0, 2)


def test_learns():
    rng = np.random.default_rng(5)
    y = np.arange(240) % 3
    x = rng.normal(size=(240, 12, 4)) * 0.4
    for c in range(3):
        x[y == c, :, c] += np.sin(np.arange(12) * (c + 1))
    rows = (x.astype(np.float32), y, np.arange(240), np.arange(240) % 5 == 0)
    state = temporal._fit(rows, 192, np.array([64.0] * 3), 4, replace(SMALL, epochs=12), lambda a: np.asarray(a), lambda: None, lambda _: None)
    assert state["notes"]["best"] > 0.9


def test_macro_f1():
    assert macro_f1(np.array([[2.0, 0, 0], [1, 1, 0], [0, 0, 0]])) == pytest.approx((0.8 + 2 / 3 + 0) / 3)


def test_size_of_the_model():
    w, _ = start(47, 22, Options())
    assert sum(v.size for v in w.values()) == 63_702
