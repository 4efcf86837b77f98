"""The temporal model: a small convolutional network over windows, trained by all tasks of a barrier stage together (M2, M3).

Every task holds its rows and the same weights. Sums over a batch (of normalisation, loss and gradients) are made by
exchanging each task's share, so a step equals that of one task with all rows, whatever the number of tasks. Which rows make
a batch and which units drop out follow from hashes of the rows' keys. Spark's exchange between barrier tasks takes about a
second whatever its size, and a step needs two a convolution and one more, so batches should be large on many rows. After each epoch the state is written to the shared
folder, and a stage that is run again after a lost executor goes on from there.
"""

from __future__ import annotations

import base64
import io
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.session import bound_arrow, ensure_checkpoint_dir

Reduce = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Options:
    """(channels, kernel width, pool) of each convolution, and of training: rows of a batch on average, epochs without a
    better macro-F1 after which it ends, and the optimiser's constants."""

    layers: tuple[tuple[int, int, int], ...] = ((64, 5, 1), (64, 5, 2), (128, 3, 1))
    dropout: float = 0.3
    batch: int = 64
    epochs: int = 60
    patience: int = 12
    rate: float = 1e-3
    decay: float = 1e-2
    beta1: float = 0.9
    beta2: float = 0.999
    momentum: float = 0.1
    seed: int = 42


def start(features: int, classes: int, o: Options) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Weights, uniform within the root of one over the inputs of a unit, and running normalisation."""
    rng = np.random.default_rng(o.seed)
    w, run, inputs = {}, {}, features
    for k, (channels, width, _) in enumerate(o.layers):
        bound = 1 / np.sqrt(inputs * width)
        w[f"kernel{k}"], w[f"bias{k}"] = rng.uniform(-bound, bound, (width * inputs, channels)), rng.uniform(-bound, bound, channels)
        w[f"scale{k}"], w[f"shift{k}"] = np.ones(channels), np.zeros(channels)
        run[f"mean{k}"], run[f"var{k}"] = np.zeros(channels), np.ones(channels)
        inputs = channels
    bound = 1 / np.sqrt(inputs)
    w["head"], w["bias"] = rng.uniform(-bound, bound, (inputs, classes)), rng.uniform(-bound, bound, classes)
    return w, run


def _unfold(x: np.ndarray, width: int) -> np.ndarray:
    """(n, t, width * channels): each step's neighbours, zeros beyond the ends."""
    padded = np.pad(x, ((0, 0), (width // 2, width - 1 - width // 2), (0, 0)))
    return np.lib.stride_tricks.sliding_window_view(padded, width, 1).transpose(0, 1, 3, 2).reshape(*x.shape[:2], width * x.shape[2])


def _fold(d: np.ndarray, width: int, channels: int) -> np.ndarray:
    n, t, _ = d.shape
    out = np.zeros((n, t + width - 1, channels))
    for k in range(width):
        out[:, k : k + t] += d[:, :, k * channels : (k + 1) * channels]
    return out[:, width // 2 : width // 2 + t]


def _cells(x: np.ndarray, pool: int) -> np.ndarray:
    """(n, t // pool, pool, channels); steps beyond the last whole cell are left out."""
    n, t, channels = x.shape
    return x[:, : t // pool * pool].reshape(n, t // pool, pool, channels)


def logits(x: np.ndarray, w: dict, run: dict, o: Options) -> np.ndarray:
    """Of (n, time, features), with running normalisation and nothing dropped."""
    for k, (_, width, pool) in enumerate(o.layers):
        z = _unfold(x, width) @ w[f"kernel{k}"] + w[f"bias{k}"]
        x = np.maximum((z - run[f"mean{k}"]) / np.sqrt(run[f"var{k}"] + 1e-5) * w[f"scale{k}"] + w[f"shift{k}"], 0)
        x = _cells(x, pool).max(2)
    return x.mean(1) @ w["head"] + w["bias"]


def step(x: np.ndarray, y: np.ndarray, weight: np.ndarray, mass: float, keep: np.ndarray, w: dict, run: dict, o: Options, total: Reduce) -> tuple[float, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(loss, gradients, running normalisation) of a batch of which x are this task's rows; mass: the weight of the whole
    batch, keep: which units stay, scaled. `total` sums an array over tasks."""
    kept, new = [], dict(run)
    for k, (channels, width, pool) in enumerate(o.layers):
        columns = _unfold(x, width)
        z = columns @ w[f"kernel{k}"] + w[f"bias{k}"]
        sums = total(np.stack([z.sum((0, 1)), (z * z).sum((0, 1)), np.full(channels, float(z.shape[0] * z.shape[1]))]))
        m = sums[2, 0]
        mean = sums[0] / m
        var = np.maximum(sums[1] / m - mean**2, 0.0)
        unit = (z - mean) / np.sqrt(var + 1e-5)
        a = np.maximum(unit * w[f"scale{k}"] + w[f"shift{k}"], 0)
        cells = _cells(a, pool)
        kept.append((x.shape, columns, unit, var, m, a, cells.argmax(2)))
        x = cells.max(2)
        new[f"mean{k}"] = (1 - o.momentum) * run[f"mean{k}"] + o.momentum * mean
        new[f"var{k}"] = (1 - o.momentum) * run[f"var{k}"] + o.momentum * var * m / max(1, m - 1)
    pooled = x.mean(1) * keep
    out = pooled @ w["head"] + w["bias"]
    e = np.exp(out - out.max(1, keepdims=True, initial=-np.inf)) if len(out) else out
    p = e / e.sum(1, keepdims=True)
    loss = -(weight * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum()
    d = p.copy()
    d[np.arange(len(y)), y] -= 1
    d *= weight[:, None] / mass
    g = {"head": pooled.T @ d, "bias": d.sum(0)}
    d = np.repeat(((d @ w["head"].T) * keep)[:, None] / x.shape[1], x.shape[1], 1)
    for k in reversed(range(len(o.layers))):
        channels, width, pool = o.layers[k]
        shape, columns, unit, var, m, a, best = kept[k]
        back = np.zeros((*d.shape[:2], pool, channels))
        np.put_along_axis(back, best[:, :, None], d[:, :, None], 2)
        whole = np.zeros_like(a)
        whole[:, : d.shape[1] * pool] = back.reshape(len(a), d.shape[1] * pool, channels)
        d = whole * (a > 0)
        g[f"scale{k}"], g[f"shift{k}"] = (d * unit).sum((0, 1)), d.sum((0, 1))
        d = d * w[f"scale{k}"]
        sums = total(np.stack([d.sum((0, 1)), (d * unit).sum((0, 1))]))
        d = (d - (sums[0] + unit * sums[1]) / m) / np.sqrt(var + 1e-5)
        g[f"kernel{k}"], g[f"bias{k}"] = columns.reshape(-1, columns.shape[2]).T @ d.reshape(-1, channels), d.sum((0, 1))
        d = _fold(d @ w[f"kernel{k}"].T, width, shape[2])
    names = sorted(g)
    flat = total(np.concatenate([*(g[n].ravel() for n in names), [loss]]))
    ends = np.cumsum([g[n].size for n in names])
    return float(flat[-1] / mass), {n: part.reshape(g[n].shape) for n, part in zip(names, np.split(flat, ends), strict=False)}, new


def macro_f1(confusion: np.ndarray) -> float:
    right = np.diag(confusion)
    both = confusion.sum(0) + confusion.sum(1)
    return float(np.where(both > 0, 2 * right / np.maximum(both, 1), 0.0).mean())


@dataclass
class Temporal:
    """A trained model; called with (n, time, features) it gives (n, classes) logits, as `models.class_scores` wants."""

    labels: list
    weights: dict[str, np.ndarray]
    running: dict[str, np.ndarray]
    options: Options
    history: list[dict] = field(default_factory=list)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return logits(np.asarray(x, float), self.weights, self.running, self.options)


def _drawn(keys: np.ndarray, *salt: int) -> np.ndarray:
    """A hash of each key and the salts, as doubles of [0, 1); splitmix64 steps."""
    h = keys.astype(np.uint64)
    with np.errstate(over="ignore"):
        for s in (*salt, 1):
            h = (h ^ np.uint64(s)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(30)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(27)
    return (h >> np.uint64(11)).astype(float) / 2**53


def _saved(state: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{k: v for k, v in state.items() if k != "notes"}, notes=np.array(json.dumps(state["notes"])))
    return out.getvalue()


def _fit(rows: tuple[np.ndarray, ...], n: int, counts: np.ndarray, features: int, o: Options, total: Reduce, load: Callable[[], bytes | None], save: Callable[[bytes], None]) -> dict:
    """All epochs of one task; `load` and `save` a state, the latter on one task."""
    x, y, key, held = rows
    classes = len(counts)
    weight = np.where(counts > 0, counts.sum() / (np.count_nonzero(counts) * np.maximum(counts, 1)), 0.0)
    w, run = start(features, classes, o)
    state = {**{f"w_{k}": v for k, v in w.items()}, **{f"r_{k}": v for k, v in run.items()}, **{f"{a}_{k}": np.zeros_like(v) for k, v in w.items() for a in "mv"}, "notes": {"t": 0, "history": [], "best": -1.0, "best_epoch": -1}}
    state |= {f"bw_{k}": v for k, v in w.items()} | {f"br_{k}": v for k, v in run.items()}
    if (old := load()) is not None:
        with np.load(io.BytesIO(old)) as z:
            state = {k: z[k] for k in z.files}
        state["notes"] = json.loads(str(state["notes"]))
    notes = state["notes"]
    steps = max(1, -(-n // o.batch))
    for epoch in range(len(notes["history"]), o.epochs):
        if epoch - notes["best_epoch"] > o.patience:
            break
        at = np.where(held, -1, (_drawn(key, o.seed, epoch, 7) * steps).astype(int))
        losses, masses = [], total(np.bincount(at[~held], weight[y[~held]], steps))
        for s in np.flatnonzero(masses > 0):
            mine = np.flatnonzero(at == s)
            w, run = {k: state[f"w_{k}"] for k in w}, {k: state[f"r_{k}"] for k in run}
            units = o.layers[-1][0]
            keep = np.stack([_drawn(key[mine], o.seed, epoch, 100 + u) >= o.dropout for u in range(units)], 1) / (1 - o.dropout) if o.dropout else np.ones((len(mine), units))
            loss, g, run = step(x[mine].astype(float), y[mine], weight[y[mine]], masses[s], keep, w, run, o, total)
            losses.append(loss)
            notes["t"] += 1
            for k in w:
                state[f"m_{k}"] = o.beta1 * state[f"m_{k}"] + (1 - o.beta1) * g[k]
                state[f"v_{k}"] = o.beta2 * state[f"v_{k}"] + (1 - o.beta2) * g[k] ** 2
                mean, var = state[f"m_{k}"] / (1 - o.beta1 ** notes["t"]), state[f"v_{k}"] / (1 - o.beta2 ** notes["t"])
                state[f"w_{k}"] = w[k] * (1 - o.rate * o.decay) - o.rate * mean / (np.sqrt(var) + 1e-8)
            state |= {f"r_{k}": v for k, v in run.items()}
        w, run = {k: state[f"w_{k}"] for k in w}, {k: state[f"r_{k}"] for k in run}
        confusion = np.zeros((classes, classes))
        for a in range(0, len(x), 256):
            part = np.flatnonzero(held[a : a + 256]) + a
            if len(part):
                np.add.at(confusion, (y[part], logits(x[part].astype(float), w, run, o).argmax(1)), 1)
        confusion = total(confusion)
        f1 = macro_f1(confusion)
        notes["history"].append({"epoch": epoch, "loss": float(np.mean(losses)) if losses else 0.0, "accuracy": float(np.trace(confusion) / max(1, confusion.sum())), "macro_f1": f1})
        if f1 > notes["best"]:
            notes |= {"best": f1, "best_epoch": epoch}
            state |= {f"bw_{k}": v for k, v in w.items()} | {f"br_{k}": v for k, v in run.items()}
        save(_saved(state))
    return state


def train(windows: DataFrame, label: str, key: str, held_out: str, tasks: int = 4, o: Options = Options()) -> Temporal:
    """The model of windows (`rows`, arrays of arrays of one shape) with their labels; rows whose boolean column `held_out`
    is true validate. `tasks` barrier tasks run at once, each with its rows in memory as floats. Rows without rows or label
    take no part. The best epoch's weights are kept; the driver gets them and the history."""
    spark = windows.sparkSession
    bound_arrow(spark)
    own = windows.where(F.col("rows").isNotNull() & F.col(label).isNotNull() & (F.size("rows") > 0))
    held = F.coalesce(F.col(held_out), F.lit(False))
    counts = own.groupBy(label).agg(F.count_if(~held).alias("n")).limit(10_001).collect()
    if not counts or len(counts) > 10_000:
        raise ValueError(f"training needs between 1 and 10,000 labels, not {len(counts)}")
    labels = sorted(r[0] for r in counts)
    per = np.array([dict((r[0], r[1]) for r in counts)[v] for v in labels], float)
    first = own.select("rows").first()[0]
    time, features = len(first), len(first[0])
    folder, place = f"{ensure_checkpoint_dir(spark)}/training-{uuid.uuid4().hex}", {v: k for k, v in enumerate(labels)}
    n = int(per.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from cadence.sources.archives import opened

        context = BarrierTaskContext.get()
        me, system = context.partitionId(), None
        parts: list[list] = [[], [], [], []]
        for b in batches:
            flat = b.column(0).flatten().flatten().to_numpy(zero_copy_only=False)
            parts[0].append(np.nan_to_num(flat.astype(np.float32)).reshape(-1, time, features))
            parts[1].append(np.array([place[v] for v in b.column(1).to_pylist()], np.int64))
            parts[2].append(b.column(2).to_numpy(zero_copy_only=False))
            parts[3].append(b.column(3).to_numpy(zero_copy_only=False).astype(bool))
        empty = (np.zeros((0, time, features), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        x, y, k, h = (np.concatenate([*p, e]) for p, e in zip(parts, empty, strict=True))
        order = np.argsort(k, kind="stable")
        system, root = opened(folder)

        def total(a: np.ndarray) -> np.ndarray:
            shares = context.allGather(base64.b64encode(np.ascontiguousarray(a, float).tobytes()).decode())
            return np.sum([np.frombuffer(base64.b64decode(s)) for s in shares], 0).reshape(np.shape(a))

        def load() -> bytes | None:
            if system.get_file_info(f"{root}/state.npz").type != fs.FileType.File:
                return None
            with system.open_input_stream(f"{root}/state.npz") as file:
                return file.read()

        def save(data: bytes) -> None:
            if me == 0:
                system.create_dir(root)
                with system.open_output_stream(f"{root}/_next.npz") as file:
                    file.write(data)
                system.move(f"{root}/_next.npz", f"{root}/state.npz")
            context.barrier()

        context.barrier()
        state = _fit((x[order], y[order], k[order], h[order]), n, per, features, o, total, load, save)
        if me == 0:
            yield pa.RecordBatch.from_arrays([pa.array([_saved(state)], pa.binary())], ["state"])

    dealt = own.select("rows", F.col(label).alias("y"), F.xxhash64(key).alias("k"), held.alias("h")).repartition(tasks, "k")
    (row,) = dealt.mapInArrow(run, "state binary", barrier=True).collect()
    with np.load(io.BytesIO(row.state)) as z:
        state = {k: z[k] for k in z.files}
    pick = lambda p: {k.removeprefix(p): v for k, v in state.items() if k.startswith(p)}
    return Temporal(labels, pick("bw_"), pick("br_"), replace(o), json.loads(str(state["notes"]))["history"])
