"""Debounce, holds, smoothing, sessions and rate limits as kernels."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np

from cadence.kernels.base import Kernel, is_number

IDLE, DETECTING, COUNTING, RESTING = "idle", "detecting", "counting", "resting"


class HoldTimer(Kernel):
    """How long a position is held: (ts_ms, holding, current_ms, best_ms, ended_ms). A false row more than `grace_ms` after
    the last true one ends a hold; shorter holds than `least_ms` are not recorded."""

    inputs = ("ts_ms", "ok")
    output = "ts_ms double, holding boolean, current_ms double, best_ms double, ended_ms double"

    def __init__(self, grace_ms: float = 400, least_ms: float = 1000) -> None:
        self.grace_ms, self.least_ms = grace_ms, least_ms

    def start(self):
        return {"since": None, "good": None, "current": 0.0, "best": 0.0}

    def advance(self, s, t: float, ok: bool):
        if ok:
            s["since"] = t if s["since"] is None else s["since"]
            s.update(good=t, current=t - s["since"])
            s["best"] = max(s["best"], s["current"])
        elif s["since"] is not None:
            if t - s["good"] > self.grace_ms:
                return self.close(s)
            s["current"] = t - s["since"]
        return None

    def close(self, s):
        """End a running hold at its last good row; its length if it is long enough to be recorded."""
        if s["since"] is None:
            return None
        length = s["good"] - s["since"]
        s.update(since=None, good=None, current=0.0)
        return length if length >= self.least_ms else None

    def step(self, s, row):
        t, ok = row
        ended = self.advance(s, t, bool(ok))
        return s, [(float(t), s["since"] is not None, float(s["current"]), float(s["best"]), None if ended is None else float(ended))]


class Debounce(Kernel):
    """Ids that have been active without a break for `hold_ms`: (ts_ms, visible). Each id has its own clock."""

    inputs = ("ts_ms", "active")
    output = "ts_ms double, visible array<string>"

    def __init__(self, hold_ms: float = 500) -> None:
        self.hold_ms = hold_ms

    def start(self):
        return {}

    def advance(self, s, t, active):
        s = {i: s.get(i, t) for i in (active if active is not None else ())}
        return s, [i for i, since in s.items() if t - since >= self.hold_ms]

    def step(self, s, row):
        t, active = row
        s, visible = self.advance(s, t, active)
        return s, [(float(t), visible)]


def low_pass_weight(cutoff, dt):
    return 1 / (1 + 1 / (2 * math.pi * cutoff * dt))


@dataclass
class OneEuro:
    """The adaptive low-pass of one value."""

    min_cutoff: float = 1.0
    beta: float = 10.0
    d_cutoff: float = 1.0
    x: float | None = None
    speed: float = 0.0
    t: float | None = None

    def feed(self, v: float | None, t: float) -> float | None:
        if not is_number(v):
            return v
        dt = (t - self.t) / 1000 if self.t is not None else 0.0
        if dt <= 0:
            self.x, self.speed, self.t = v, 0.0, t
            return v
        a = low_pass_weight(self.d_cutoff, dt)
        self.speed = a * (v - self.x) / dt + (1 - a) * self.speed
        a = low_pass_weight(self.min_cutoff + self.beta * abs(self.speed), dt)
        self.x, self.t = a * v + (1 - a) * self.x, t
        return self.x


class ValueFilter(Kernel):
    inputs = ("ts_ms", "value")
    output = "ts_ms double, filtered double"

    def __init__(self, min_cutoff: float = 1.0, beta: float = 10.0, d_cutoff: float = 1.0) -> None:
        self.options = (min_cutoff, beta, d_cutoff)

    def start(self):
        return OneEuro(*self.options)

    def step(self, s, row):
        t, v = row
        out = s.feed(v, t)
        return s, [(float(t), None if out is None else float(out))]


class PoseFilter:
    """One filter per coordinate of a pose, all of them at once; frames without a pose change nothing."""

    AXES = ("x", "y", "z")

    def __init__(self, min_cutoff: float = 1.0, beta: float = 10.0, d_cutoff: float = 1.0) -> None:
        self.options = (min_cutoff, beta, d_cutoff)
        self.x = self.speed = self.t = np.zeros((0, len(self.AXES)))

    def _grow(self, n: int) -> None:
        more = np.full((max(0, n - len(self.x)), len(self.AXES)), np.nan)
        if len(more):
            self.x, self.speed, self.t = (np.concatenate([a, more]) for a in (self.x, self.speed, self.t))

    def _filtered(self, v: np.ndarray, t: float) -> np.ndarray:
        min_cutoff, beta, d_cutoff = self.options
        x, speed, last = self.x[: len(v)], self.speed[: len(v)], self.t[: len(v)]
        known, dt = np.isfinite(v), (t - last) / 1000
        runs = dt > 0
        with np.errstate(invalid="ignore", divide="ignore"):
            a = low_pass_weight(d_cutoff, dt)
            pace = np.where(runs, a * (v - x) / dt + (1 - a) * speed, 0.0)
            a = low_pass_weight(min_cutoff + beta * np.abs(pace), dt)
            out = np.where(runs, a * v + (1 - a) * x, v)
        for kept, now in ((x, out), (speed, pace), (last, t)):
            np.copyto(kept, now, where=known)
        return out

    def feed(self, pose, t: float):
        if pose is None:
            return None
        seen = [None if p is None else dict(p) if isinstance(p, dict) else dict(zip((*self.AXES, "visibility"), p, strict=True)) for p in pose]
        raw = [(None,) * len(self.AXES) if p is None else [p.get(a) for a in self.AXES] for p in seen]
        v = np.array(raw, float).reshape(len(seen), len(self.AXES))
        self._grow(len(v))
        for p, old, new in zip(seen, raw, self._filtered(v, t).tolist(), strict=True):
            if p is not None:
                p.update((a, n if is_number(o) else o) for a, o, n in zip(self.AXES, old, new, strict=True))
        return seen


class ScoreSmoother(Kernel):
    """Class scores of windows, smoothed and judged: (ts_ms, label, confidence, margin, uncertain, reason)."""

    inputs = ("ts_ms", "scores", "poor_pose")
    output = "ts_ms double, label string, confidence double, margin double, uncertain boolean, reason string"

    def __init__(self, labels: list[str], smoothing: float = 0.4, min_confidence: float = 0.65, min_margin: float = 0.45) -> None:
        if not labels:
            raise ValueError("a smoother needs labels")
        self.labels, self.smoothing, self.min_confidence, self.min_margin = list(labels), smoothing, min_confidence, min_margin

    def start(self):
        return None

    def judge(self, state, scores, poor: bool):
        if len(scores) != len(self.labels):
            raise ValueError(f"{len(scores)} scores for {len(self.labels)} labels")
        top = max(scores)
        raised = [math.exp(v - top) for v in scores]
        total = sum(raised)
        now = [v / total for v in raised]
        if state is not None:
            now = [self.smoothing * v + (1 - self.smoothing) * p for v, p in zip(now, state, strict=True)]
        order = sorted(range(len(now)), key=lambda i: (-now[i], i))
        best = now[order[0]]
        margin = best - (now[order[1]] if len(order) > 1 else 0.0)
        reason = "poor-pose" if poor else "low-confidence" if best < self.min_confidence else "close-call" if margin < self.min_margin else None
        return now, (self.labels[order[0]], best, margin, reason is not None, reason)

    def step(self, s, row):
        t, scores, poor = row
        s, seen = self.judge(s, list(scores), bool(poor))
        return s, [(float(t), *seen)]


@dataclass(frozen=True)
class OpenSet:
    label: str | None
    start_ms: float
    reps: int = 0
    warned: int = 0
    warned_now: bool = False
    hold_ms: float = 0.0
    confidence: float | None = None


@dataclass(frozen=True)
class Session:
    """The phases of a workout: idle until started; a set is open while detecting or counting; after `rest_ms` without
    activity it closes, and the next activity opens another. Closed sets that counted or held something are recorded."""

    stable: int = 2
    rest_ms: float = 3000
    phase: str = IDLE
    manual: str | None = None
    candidate: str | None = None
    streak: int = 0
    set_id: int = 0
    set: OpenSet | None = None
    active_ms: float | None = None
    closed: tuple = field(default=())

    def _shut(self, t: float) -> Session:
        s = self.set
        if s is None or s.reps == 0 and s.hold_ms == 0:
            return replace(self, set=None)
        record = (s.label, self.manual is not None, s.reps, s.warned, s.hold_ms, s.start_ms, t, t - s.start_ms)
        return replace(self, set=None, closed=(*self.closed, record))

    def _open(self, t: float) -> Session:
        return replace(self, phase=COUNTING if self.manual else DETECTING, set=OpenSet(self.manual, t), set_id=self.set_id + 1, candidate=None, streak=0, active_ms=t)

    def begin(self, t: float) -> Session:
        return self._open(t) if self.phase == IDLE else self

    def stop(self, t: float) -> Session:
        return replace(self._shut(t), phase=IDLE, candidate=None, streak=0)

    def choose(self, label: str | None, t: float) -> Session:
        """Set (or with None lift) the exercise by hand; a running set closes and a new one opens."""
        shut = replace(self._shut(t), manual=label)
        return shut if self.phase == IDLE else shut._open(t)

    def predict(self, label: str, confidence: float, uncertain: bool) -> Session:
        """A label locks at the `stable`-th certain prediction of it in a row."""
        if self.phase != DETECTING or self.manual:
            return self
        if uncertain:
            return replace(self, candidate=None, streak=0)
        streak = self.streak + 1 if label == self.candidate else 1
        kept = replace(self, candidate=label, streak=streak)
        return kept if streak < self.stable else replace(kept, phase=COUNTING, set=replace(self.set, label=label, confidence=confidence))

    def frame(self, t: float, moving: bool, reps: int = 0, hold_ms: float = 0.0, holding: bool = False, warning: bool = False) -> Session:
        if self.phase == IDLE:
            return self
        active = moving or holding
        if self.phase == RESTING:
            return self._open(t) if active else self
        s, warned = self.set, self.set.warned_now or warning
        if reps > s.reps:
            s = replace(s, reps=reps, warned=s.warned + warned, warned_now=False, hold_ms=max(s.hold_ms, hold_ms))
        elif warned != s.warned_now or hold_ms > s.hold_ms:
            s = replace(s, warned_now=warned, hold_ms=max(s.hold_ms, hold_ms))
        kept = replace(self, set=s, active_ms=t if active else self.active_ms) if active or s is not self.set else self
        return kept if t - kept.active_ms <= self.rest_ms else replace(kept._shut(t), phase=RESTING, candidate=None, streak=0)


SET_COLUMNS = "label string, manual boolean, reps int, reps_with_warning int, hold_ms double, start_ms double, end_ms double, duration_ms double"


class SessionKernel(Kernel):
    """Rows of frames, controls and predictions to closed sets. `kind` is start, stop, choose, predict, forget or NULL for
    a frame; `label`, `confidence` and `uncertain` belong to choose and predict."""

    inputs = ("ts_ms", "kind", "label", "confidence", "uncertain", "moving", "reps", "hold_ms", "holding", "warning")
    output = SET_COLUMNS

    def __init__(self, stable: int = 2, rest_ms: float = 3000, started: bool = False) -> None:
        self.stable, self.rest_ms, self.started = stable, rest_ms, started

    def start(self):
        return Session(self.stable, self.rest_ms)

    def step(self, s, row):
        t, kind, label, confidence, uncertain, moving, reps, hold_ms, holding, warning = row
        if self.started and s.set_id == 0 and s.phase == IDLE:
            s = s.begin(t)
        if kind == "start":
            s = s.begin(t)
        elif kind == "stop":
            s = s.stop(t)
        elif kind == "choose":
            s = s.choose(label, t)
        elif kind == "predict":
            s = s.predict(label, confidence, bool(uncertain))
        elif kind != "forget":
            s = s.frame(t, bool(moving), int(reps or 0), float(hold_ms or 0), bool(holding), bool(warning))
        return replace(s, closed=()) if s.closed else s, [(r[0], r[1], int(r[2]), int(r[3]), *map(float, r[4:])) for r in s.closed]


class RateLimiter(Kernel):
    """(said_ms, text): the newest waiting text, at most one per `gap_ms`; `enabled` False drops what waits."""

    inputs = ("ts_ms", "text", "enabled")
    output = "said_ms double, text string"

    def __init__(self, gap_ms: float = 2000) -> None:
        self.gap_ms = gap_ms

    def start(self):
        return {"last": None, "waiting": None, "on": True}

    def say(self, s, text) -> None:
        if s["on"] and text is not None:
            s["waiting"] = text

    def enable(self, s, on: bool) -> None:
        s["on"] = on
        if not on:
            s["waiting"] = None

    def release(self, s, t):
        if s["waiting"] is None or s["last"] is not None and t - s["last"] < self.gap_ms:
            return None
        text, s["waiting"], s["last"] = s["waiting"], None, t
        return text

    def step(self, s, row):
        t, text, enabled = row
        if enabled is not None and not (isinstance(enabled, float) and math.isnan(enabled)):
            self.enable(s, bool(enabled))
        self.say(s, text)
        said = self.release(s, t)
        return s, [] if said is None else [(float(t), said)]


class Ema(Kernel):
    """Exponential smoothing; missing values are passed over."""

    inputs = ("ts_ms", "value")
    output = "ts_ms double, smoothed double"

    def __init__(self, weight: float) -> None:
        self.weight = weight

    def start(self):
        return None

    def step(self, s, row):
        t, v = row
        if v is None:
            return s, []
        s = v if s is None else self.weight * v + (1 - self.weight) * s
        return s, [(float(t), float(s))]
