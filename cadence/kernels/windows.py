"""Feature windows of a pose stream, frame by frame, equal to the windows of the whole sequence."""

from __future__ import annotations

import numpy as np

from cadence.kernels.base import Kernel
from cadence.kernels.pose import feature_rows, fill_gaps, kept_values, mirrored

# Fixed values of the feature windows.
FPS, LENGTH, STRIDE, GAP, MISSING, WIDTH = 15.0, 30, 15, 5, 0.3, 47
DELAY = CONTEXT = GAP + 1


def nearest_rows(times: np.ndarray, fps: float = FPS) -> np.ndarray:
    """For each tick the index of the nearest time, the lower of two equally near ones."""
    if not len(times):
        return np.zeros(0, int)
    step = 1000 / fps
    ticks = times[0] + np.arange(int((times[-1] - times[0]) // step) + 1) * step
    after = np.searchsorted(times, ticks)
    low, high = np.clip(after - 1, 0, len(times) - 1), np.minimum(after, len(times) - 1)
    return np.where(np.abs(times[low] - ticks) <= np.abs(times[high] - ticks), low, high)


def sequence_features(poses: list, times, width: float, height: float, fps: float = FPS) -> np.ndarray:
    """(ticks, features) of a whole recording, gaps filled."""
    values = [kept_values(poses[i]) for i in nearest_rows(np.asarray(times, float), fps)]
    return fill_gaps(feature_rows(values, width, height))


def cut_windows(rows: np.ndarray, length: int = LENGTH, stride: int = STRIDE) -> list[tuple[int, np.ndarray, float]]:
    """(start, window with 0 for missing, share of missing rows) of full windows."""
    gone = ~np.isfinite(rows).all(axis=1)
    return [(a, np.where(np.isfinite(rows[a : a + length]), rows[a : a + length], 0.0), float(gone[a : a + length].mean())) for a in range(0, len(rows) - length + 1, stride)]


class WindowStream(Kernel):
    """(start, missing_ratio, usable, rows) as soon as no later frame can change a window: one frame to settle a tick,
    `DELAY` ticks so that every short gap is closed. `finish` releases what still waits. Settled ticks wait as the few
    values that matter of their poses; features are made of all waiting ones at once when rows are due."""

    inputs = ("ts_ms", "pose", "width", "height")
    output = "start int, missing_ratio double, usable boolean, rows array<array<double>>"

    def start(self):
        return {"first": None, "tick": None, "ticks": 0, "before": None, "rows": np.zeros((0, WIDTH)), "offset": 0, "waiting": [], "next": 0}

    def _due(self, s, tail: bool) -> bool:
        return s["next"] + LENGTH + (0 if tail else DELAY) <= s["ticks"]

    def _emit(self, s, tail: bool) -> list[tuple]:
        out = []
        while self._due(s, tail):
            base = max(s["offset"], s["next"] - CONTEXT)
            filled = fill_gaps(s["rows"][base - s["offset"] : s["next"] + LENGTH + DELAY - s["offset"]], GAP)
            (_, window, missing), *_ = cut_windows(filled[s["next"] - base : s["next"] - base + LENGTH])
            out.append((s["next"], missing, missing <= MISSING, window.tolist()))
            s["next"] += STRIDE
        return out

    def _release(self, s, tail: bool) -> list[tuple]:
        if not self._due(s, tail):
            return []
        values, width, height = zip(*s["waiting"]) if s["waiting"] else ((), (), ())
        s["rows"], s["waiting"] = np.concatenate([s["rows"], feature_rows(values, width, height)]), []
        out = self._emit(s, tail)
        keep = max(s["offset"], s["next"] - CONTEXT)
        s["rows"], s["offset"] = s["rows"][keep - s["offset"] :], keep
        return out

    def step(self, s, row):
        t, pose, width, height = row
        pace = 1000 / FPS
        if s["first"] is None:
            s["first"] = s["tick"] = float(t)
        while s["tick"] <= t:
            old = s["before"]
            use = old if old is not None and s["tick"] - old[0] <= t - s["tick"] else (t, pose)
            s["waiting"].append((kept_values(use[1]), width, height))
            s["ticks"] += 1
            s["tick"] = s["first"] + s["ticks"] * pace
        s["before"] = (t, pose)
        return s, self._release(s, False)

    def finish(self, s):
        return self._release(s, True)


class FeatureStream(WindowStream):
    """(k, missing, features) per tick, gaps filled, as soon as no later frame can change a row."""

    output = "k int, missing boolean, features array<double>"

    def _due(self, s, tail: bool) -> bool:
        return s["next"] + (0 if tail else DELAY) < s["ticks"]

    def _emit(self, s, tail: bool) -> list[tuple]:
        stop = s["ticks"] - (0 if tail else DELAY)
        filled = fill_gaps(s["rows"], GAP)[s["next"] - s["offset"] : stop - s["offset"]]
        known = np.isfinite(filled)
        whole = known.all(axis=1).tolist()
        shown = np.where(known, filled, None).tolist()
        out = [(s["next"] + i, not whole[i], shown[i]) for i in range(len(shown))]
        s["next"] = stop
        return out


class TimedWindows(WindowStream):
    """Windows with the time of the frame that released them; what only the end of a stream would release is left out,
    since no frame can follow it."""

    output = "ts_ms double, start int, missing_ratio double, rows array<array<double>>"

    def step(self, s, row):
        s, out = super().step(s, row)
        return s, [(float(row[0]), start, missing, rows) for start, missing, _, rows in out]

    def finish(self, s):
        return []


def reference_stages(poses: list, times, width: float, height: float) -> dict:
    """What every stage makes of one recording: a fixture to hold other implementations against."""
    rows = sequence_features(poses, times, width, height)
    cut = cut_windows(rows)
    plain = lambda a: [[None if not np.isfinite(v) else round(float(v), 6) for v in r] for r in a]
    return {
        "resample_indices": nearest_rows(np.asarray(times, float)).tolist(),
        "features": plain(rows),
        "missing": (~np.isfinite(rows).all(axis=1)).tolist(),
        "window_starts": [a for a, _, _ in cut],
        "missing_ratio": [m for _, _, m in cut],
        "usable": [m <= MISSING for _, _, m in cut],
        "windows": [plain(w) for _, w, _ in cut],
        "flipped_first_window": plain(mirrored(cut[0][1])) if cut else [],
    }
