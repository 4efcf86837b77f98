"""Counters of repeated movements on a value or on a whole pose."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from cadence.kernels.base import Kernel, is_number, round_up
from cadence.kernels.pose import ANGLE_COUNT, angles_of, features_of, motion_of

LOW, HIGH = 0, 1


@dataclass(frozen=True)
class SignalOptions:
    """Fixed values of the counter's rules; amplitude 0.2 suits the main axis of a pose, 0.08 a single joint angle."""

    fps: float = 15.0
    buffer_s: float = 4.0
    smoothing: float = 0.5
    home_s: float = 0.5
    regrowth: float = 2.0
    low_zone: float = 0.3
    high_zone: float = 0.7
    full_swing: float = 0.85
    min_amplitude: float = 0.2
    min_period_s: float = 0.5
    min_confidence: float = 0.4
    gap_fraction: float = 0.6
    gap_s: float = 0.4
    switch_ratio: float = 1.5
    same_axis: float = 0.8
    motion_s: float = 1.0
    iterations: int = 6

    @property
    def capacity(self) -> int:
        return max(4, round_up(self.buffer_s * self.fps))


def period_of(x: np.ndarray, min_lag: int, min_confidence: float) -> int | None:
    """Lag of the shortest strong peak of the unbiased, normalised autocorrelation; None if there is none."""
    n = len(x)
    c = x - x.sum() / n
    full = np.correlate(c, c, "full")[n - 1 :]
    if full[0] == 0:
        return None
    r = full[: n // 2 + 1] / np.arange(n, n - n // 2 - 1, -1) / (full[0] / n)
    inner = np.arange(max(min_lag, 1), len(r) - 1)
    peaks = inner[(r[inner] >= r[inner - 1]) & (r[inner] >= r[inner + 1]) & (r[inner] >= min_confidence)] if len(inner) else inner
    if not len(peaks):
        return None
    strong = peaks[r[peaks] >= 0.9 * r[peaks].max()]
    return int(strong[0])


def quantile(ordered: np.ndarray, q: float) -> float:
    """Linear between the sorted values."""
    at = (len(ordered) - 1) * q
    k = int(at)
    return float(ordered[k] + (ordered[min(k + 1, len(ordered) - 1)] - ordered[k]) * (at - k))


@dataclass
class Zones:
    """Where the signal rests, where it is, and what has been counted."""

    home: int | None = None
    home_range: float = 0.0
    home_count: int = 0
    zone: int | None = None
    away: float = 0.0
    period_s: float | None = None
    last_ms: float = -math.inf
    count: int = 0

    def forget_home(self) -> None:
        self.home, self.home_range, self.zone, self.away = None, 0.0, None, 0.0

    def _settle(self, x: np.ndarray, low: float, span: float, o: SignalOptions) -> None:
        confirmed = self.count > self.home_count
        if self.home is not None and (confirmed or span <= o.regrowth * self.home_range):
            return
        head = x[: max(1, round_up(o.home_s * o.fps))].mean()
        home = HIGH if head >= low + span / 2 else LOW
        self.home_range, self.home_count = span, self.count
        if home != self.home:
            self.home, self.zone, self.away = home, None, 0.0

    def advance(self, x: np.ndarray, at_ms: float, o: SignalOptions) -> bool:
        """Take in a window that ends with the current value; true if a repetition ends here."""
        ordered = np.sort(x)
        low, span = quantile(ordered, 0.05), quantile(ordered, 0.95)
        span -= low
        if not span >= o.min_amplitude:
            return False
        lag = period_of(x, round_up(o.min_period_s * o.fps), o.min_confidence)
        self.period_s = lag / o.fps if lag else None
        self._settle(x, low, span, o)
        place = (x[-1] - low) / span
        depth = 1 - place if self.home == HIGH else place
        before = self.zone
        now = HIGH if x[-1] >= low + o.high_zone * span else LOW if x[-1] <= low + o.low_zone * span else before
        if now is None:
            return False
        self.zone = now
        if now != self.home:
            self.away = max(self.away, depth)
            return False
        depth, self.away = self.away, 0.0
        if before == self.home or depth == 0:
            return False
        shallow = depth < o.full_swing and self.period_s
        wait = max(o.gap_fraction * self.period_s, o.gap_s) if shallow else o.gap_s
        if at_ms - self.last_ms < 1000 * wait:
            return False
        self.count += 1
        self.last_ms = at_ms
        return True


class SignalCounter(Kernel):
    """Repetitions of one value sampled at a fixed rate: one row per counted repetition."""

    inputs = ("ts_ms", "value")
    output = "rep int, rep_ms double"

    def __init__(self, options: SignalOptions = SignalOptions()) -> None:
        self.o = options

    def start(self):
        return {"buffer": [], "smooth": None, "zones": Zones()}

    def step(self, s, row):
        t, v = row
        if not is_number(v):
            return s, []
        s["smooth"] = v if s["smooth"] is None else self.o.smoothing * v + (1 - self.o.smoothing) * s["smooth"]
        s["buffer"].append(s["smooth"])
        if len(s["buffer"]) > self.o.capacity:
            del s["buffer"][0]
        counted = s["zones"].advance(np.array(s["buffer"]), t, self.o)
        return s, [(s["zones"].count, float(t))] if counted else []


def main_axis(x: np.ndarray, previous: np.ndarray | None, iterations: int) -> np.ndarray:
    """Leading axis of centred rows by power iteration from the previous one, with its sign."""
    v = previous if previous is not None else np.full(x.shape[1], 1 / math.sqrt(x.shape[1]))
    for _ in range(iterations):
        w = x.T @ (x @ v)
        size = math.sqrt(float(w @ w))
        if size == 0:
            return previous if previous is not None else v
        v = w / size
    return -v if previous is not None and float(v @ previous) < 0 else v


class PoseCounter(Kernel):
    """Repetitions of whole-body movement. Poses are held between frames and sampled at a fixed rate; the signal is the
    window's main axis, or its busiest joint angle. One row per tick: (tick_ms, signal, moving, count, counted)."""

    inputs = ("ts_ms", "pose", "width", "height")
    output = "tick_ms double, signal double, moving boolean, count int, counted boolean"

    def __init__(self, options: SignalOptions | None = None, angle: bool = False) -> None:
        self.angle = angle
        self.o = options or SignalOptions(min_amplitude=0.08 if angle else 0.2)

    def start(self):
        return {"next": None, "motion": None, "smooth": None, "window": [], "axis": None, "channel": None, "zones": Zones(), "moving": False}

    def _signal(self, s) -> tuple[np.ndarray, bool]:
        x = np.array(s["window"])
        if self.angle:
            spread = x[:, -ANGLE_COUNT:].var(axis=0)
            best, now = int(spread.argmax()), s["channel"]
            pick = best if now is None or spread[best] > self.o.switch_ratio * spread[now] else now
            s["channel"] = pick
            return x[:, x.shape[1] - ANGLE_COUNT + pick], now is not None and pick != now
        if len(x) < 2:
            return np.zeros(1), False
        centred = x - x.mean(axis=0)
        axis = main_axis(centred, s["axis"], self.o.iterations)
        turned = s["axis"] is not None and float(axis @ s["axis"]) < self.o.same_axis
        s["axis"] = axis
        return centred @ axis, turned

    def _tick(self, s, at: float) -> tuple:
        w = self.o.smoothing
        s["smooth"] = s["motion"] if s["smooth"] is None else w * s["motion"] + (1 - w) * s["smooth"]
        s["window"] = [*s["window"], s["smooth"]][-self.o.capacity :]
        x, turned = self._signal(s)
        if turned:
            s["zones"].forget_home()
        counted = s["zones"].advance(x, at, self.o)
        recent = x[-max(2, round_up(self.o.motion_s * self.o.fps)) :]
        s["moving"] = bool(len(recent) > 1 and recent.max() - recent.min() >= 0.5 * self.o.min_amplitude)
        return float(at), float(x[-1]), s["moving"], s["zones"].count, counted

    def step(self, s, row):
        t, pose, width, height = row
        motion = motion_of(features_of(pose, width, height))
        if motion is not None:
            s["motion"] = motion
        if s["motion"] is None:
            return s, []
        if s["next"] is None:
            s["next"] = float(t)
        out, pace = [], 1000 / self.o.fps
        while t >= s["next"] and len(out) < self.o.capacity:
            out.append(self._tick(s, s["next"]))
            s["next"] += pace
        if t >= s["next"]:
            s["next"] = t + pace
        return s, out


class PeakCounter(Kernel):
    """The plain yardstick: peaks of the joint angle that varies most so far."""

    inputs = ("ts_ms", "pose", "width", "height")
    output = "rep int, rep_ms double"

    def __init__(self, prominence: float = 15.0, gap_s: float = 0.5) -> None:
        self.prominence, self.gap_s = prominence, gap_s

    def start(self):
        return {"n": 0, "mean": np.zeros(ANGLE_COUNT), "m2": np.zeros(ANGLE_COUNT), "channel": None, "last": [], "lowest": math.inf, "peak_ms": -math.inf, "count": 0}

    def step(self, s, row):
        t, pose, width, height = row
        angles = angles_of(pose, width, height)
        return self.step_angles(s, t, None if angles is None else angles * 180)

    def step_angles(self, s, t: float, angles: np.ndarray | None):
        if angles is None or not np.isfinite(angles).all():
            return s, []
        s["n"] += 1
        off = angles - s["mean"]
        s["mean"] = s["mean"] + off / s["n"]
        s["m2"] = s["m2"] + off * (angles - s["mean"])
        channel = int(s["m2"].argmax())
        value, before = float(angles[channel]), s["lowest"]
        if channel != s["channel"]:
            s["last"], s["lowest"] = [], value
        else:
            s["lowest"] = min(before, value)
        s["channel"] = channel
        s["last"] = [*s["last"], (value, float(t))][-3:]
        if len(s["last"]) < 3:
            return s, []
        (a, _), (b, at), (c, _) = s["last"]
        if b > a and b >= c and b - before >= self.prominence and at - s["peak_ms"] >= 1000 * self.gap_s:
            s["count"] += 1
            s["peak_ms"], s["lowest"] = at, c
            return s, [(s["count"], at)]
        return s, []


class ThresholdCounter(Kernel):
    """Down at `down` or less, up at `up` or more; each return counts. Feedback tells a half-way movement: one that went
    to `partial` or less without reaching `down`."""

    inputs = ("ts_ms", "value")
    output = "ts_ms double, phase string, count int, feedback string"

    def __init__(self, down: float, up: float, partial: float) -> None:
        self.down, self.up, self.partial = down, up, partial

    def start(self):
        return {"phase": "up", "count": 0, "lowest": math.inf, "feedback": None}

    def step(self, s, row):
        t, v = row
        if v is None or math.isnan(v):
            return s, []
        s["lowest"] = min(s["lowest"], v)
        if s["phase"] == "up" and v <= self.down:
            s.update(phase="down", feedback=None)
        elif s["phase"] == "down" and v >= self.up:
            s.update(phase="up", count=s["count"] + 1, lowest=math.inf, feedback="good")
        elif s["phase"] == "up" and v >= self.up:
            s["feedback"] = "partial" if s["lowest"] <= self.partial else s["feedback"]
            s["lowest"] = math.inf
        return s, [(float(t), s["phase"], s["count"], s["feedback"])]


#: Counters by name; `supports` tells which labels one can count, others are not applicable rather than zero.
REGISTRY = {
    "generic": (PoseCounter, lambda label: True),
    "generic_angle": (lambda **o: PoseCounter(angle=True, **o), lambda label: True),
    "naive": (PeakCounter, lambda label: True),
}


def register(name: str, make, supports=lambda label: True) -> None:
    REGISTRY[name] = (make, supports)


def counter(name: str, label: str | None = None, **options) -> Kernel | None:
    """A counter from the registry, or None where it does not apply to the label."""
    if name not in REGISTRY:
        raise KeyError(f"no counter {name!r}; there are {sorted(REGISTRY)}")
    make, supports = REGISTRY[name]
    return make(**options) if label is None or supports(label) else None
