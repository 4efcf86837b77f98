"""Kernels against known movements, and against plain restatements of their rules."""

import math
import random

import numpy as np
import pytest

from cadence.kernels.counters import PeakCounter, PoseCounter, SignalCounter, SignalOptions, ThresholdCounter, counter, main_axis, period_of, register
from cadence.kernels.forms import BY_LABEL, CATALOG, evaluate, judge_cycle, pose_quality
from cadence.kernels.pose import features_of, fill_gaps, mirrored
from cadence.kernels.states import Debounce, HoldTimer, PoseFilter, RateLimiter, ScoreSmoother, Session, SessionKernel, ValueFilter
from cadence.kernels.windows import LENGTH, WindowStream, cut_windows, nearest_rows, sequence_features
from cadence.kernels.workout import Workout
from cadence.sources.tables import synthetic_poses


def drive(kernel, rows):
    s, out = kernel.start(), []
    for r in rows:
        s, got = kernel.step(s, r)
        out += got
    return out + kernel.finish(s)


def swings(reps, rep_s, fps, rest_s=1.0, amplitude=0.5, noise=0.0, offset=0.0, seed=3):
    rng = np.random.default_rng(seed)
    t = np.arange(0, 2 * rest_s + reps * rep_s, 1 / fps)
    phase = np.clip(t - rest_s, 0, reps * rep_s) / rep_s
    return t * 1000, offset + amplitude * (1 - np.cos(2 * math.pi * phase)) / 2 + rng.standard_normal(len(t)) * noise


@pytest.mark.parametrize("rep_s", [0.8, 1.5, 3.0])
@pytest.mark.parametrize("amplitude", [0.5, 2.0])
@pytest.mark.parametrize("reps", [1, 3, 8])
def test_signal_counter_counts(rep_s, amplitude, reps):
    for sign, offset in ((1, 0.0), (-1, 7.0)):
        t, v = swings(reps, rep_s, 15, amplitude=amplitude)
        out = drive(SignalCounter(), list(zip(t, sign * v + offset, strict=True)))
        assert len(out) == reps and [r[0] for r in out] == list(range(1, reps + 1))


def test_signal_counter_small_and_missing():
    t, v = swings(5, 2.0, 15, amplitude=0.1)
    assert drive(SignalCounter(), list(zip(t, v, strict=True))) == []
    t, v = swings(3, 2.0, 15)
    rows = [(a, b if k % 17 else math.nan) for k, (a, b) in enumerate(zip(t, v, strict=True))]
    assert len(drive(SignalCounter(), rows)) == 3


def test_period():
    x = np.sin(2 * math.pi * np.arange(60) / 12)
    assert period_of(x, 5, 0.4) == 12
    assert period_of(np.ones(60), 5, 0.4) is None


def pose_rows(reps, rep_s=2.0, kind="squat", fps=30, drop=()):
    t, depth = swings(reps, rep_s, fps, amplitude=1.0)
    depth = depth.copy()
    for a, b in drop:
        depth[a:b] = np.nan
    return [(float(a), p, 640, 480) for a, p in zip(t, synthetic_poses(depth, kind), strict=True)]


@pytest.mark.parametrize("kind", ["squat", "curl"])
@pytest.mark.parametrize("angle", [False, True])
def test_pose_counter_counts(kind, angle):
    out = drive(PoseCounter(angle=angle), pose_rows(4, kind=kind))
    assert out[-1][3] == 4 and sum(r[4] for r in out) == 4
    still = drive(PoseCounter(angle=angle), [(k * 33.3, p, 640, 480) for k, p in enumerate(synthetic_poses(np.zeros(200)))])
    assert still[-1][3] == 0 and not still[-1][2]


def test_pose_counter_holds_and_bounds_jumps():
    rows = pose_rows(3, drop=((40, 44),))
    assert drive(PoseCounter(), rows)[-1][3] == 3
    k, s = PoseCounter(), PoseCounter().start()
    s, out = k.step(s, rows[0])
    s, out = k.step(s, (rows[0][0] + 1e6, *rows[1][1:]))
    assert len(out) == SignalOptions().capacity


def test_main_axis_is_the_leading_eigenvector():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 5)) * [5, 1, 1, 1, 1]
    x -= x.mean(0)
    a = main_axis(x, None, 60)
    w, v = np.linalg.eigh(x.T @ x)
    assert abs(abs(float(a @ v[:, -1])) - 1) < 1e-9
    assert float(main_axis(x, -a, 6) @ -a) > 0


def test_peaks_and_thresholds():
    t, v = swings(4, 2.0, 30, amplitude=90.0)
    k, s, out = PeakCounter(), PeakCounter().start(), []
    for a, b in zip(t, v, strict=True):
        s, got = k.step_angles(s, a, np.array([b, *[0.0] * 7]))
        out += got
    assert len(out) == 4
    rows = [(k, v) for k, v in enumerate([170, 120, 90, 130, 165, 125, 160, None, 80, 170])]
    out = drive(ThresholdCounter(95, 155, 130), rows)
    assert out[-1][2] == 2 and [r[3] for r in out][6] == "partial"


def test_registry():
    register("reps_only", lambda **o: SignalCounter(**o), lambda label: label != "plank")
    assert counter("reps_only", "plank") is None and counter("naive", "squat") is not None
    with pytest.raises(KeyError):
        counter("none")


def test_hold_timer():
    rows = [(t, True) for t in range(0, 2000, 50)] + [(2000, False), (2300, True), (2500, False), (2800, False), (3500, True)]
    out = drive(HoldTimer(), rows)
    assert [r[4] for r in out if r[4] is not None] == [2300.0]
    assert out[-1][1] and out[-1][3] == 2300.0


def test_debounce_and_limits():
    out = drive(Debounce(), [(0, ["a"]), (300, ["a", "b"]), (500, ["a", "b"]), (600, ["b"]), (700, ["a", "b"]), (800, ["b"])])
    assert [r[1] for r in out] == [[], [], ["a"], [], [], ["b"]]
    rows = [(0, "1", None), (500, "2", None), (900, "3", None), (2100, None, None), (2200, "4", None), (2300, None, False), (5000, None, True), (5100, "5", None)]
    assert drive(RateLimiter(), rows) == [(0.0, "1"), (2100.0, "3"), (5100.0, "5")]


def test_one_euro():
    out = drive(ValueFilter(), [(0, 1.0), (0, 5.0), (100, 5.0), (200, None), (300, 5.0)])
    assert out[0][1] == 1.0 and out[1][1] == 5.0 and out[2][1] == pytest.approx(5.0) and out[3][1] is None
    f = PoseFilter()
    assert f.feed(None, 0) is None
    a = f.feed([{"x": 0.0, "y": 0.0, "z": 0.0, "visibility": 0.3}], 0)
    b = f.feed([{"x": 1.0, "y": 0.0, "z": 0.0, "visibility": 0.4}], 33)
    assert a[0]["x"] == 0.0 and 0 < b[0]["x"] < 1 and b[0]["visibility"] == 0.4


def test_pose_filter_equals_filters_of_values():
    f, single = PoseFilter(), {}
    frames = [(0, 3), (33, 3), (33, 3), (70, None), (100, 2), (140, 4), (180, 4)]
    rng = np.random.default_rng(3)
    for n, (t, size) in enumerate(frames):
        pose = None if size is None else [None if (n, i) == (4, 1) else {"x": float(v[0]), "y": None if i == n % 3 else float(v[1]), "z": float(v[2]), "visibility": 0.5} for i, v in enumerate(rng.random((size, 3)))]
        got = f.feed(pose, t)
        for i, p in enumerate(pose or []):
            want = None if p is None else p | {a: single.setdefault((i, a), ValueFilter().start()).feed(p[a], t) for a in "xyz"}
            assert got[i] == (want if want is None else pytest.approx(want))


def test_fill_gaps_at_the_edges():
    nan = np.nan
    x = np.array([[nan, 1.0], [2.0, nan], [nan, nan], [nan, nan], [nan, nan], [nan, nan], [nan, nan], [9.0, 15.0], [nan, 16.0]])
    got = fill_gaps(x)
    assert np.nan_to_num(got[:, 0], nan=-1).tolist() == [-1, 2, pytest.approx(19 / 6), pytest.approx(26 / 6), pytest.approx(5.5), pytest.approx(40 / 6), pytest.approx(47 / 6), 9, -1]
    assert np.isnan(got[1:7, 1]).all() and fill_gaps(np.zeros((0, 4))).shape == (0, 4)


def test_smoother():
    k = ScoreSmoother(["a", "b"])
    out = drive(k, [(0, [5.0, 0.0], False), (1, [0.0, 5.0], False), (2, [0.0, 5.0], True)])
    assert [r[1] for r in out] == ["a", "a", "b"] and out[0][5] is None and out[1][5] == "low-confidence" and out[2][5] == "poor-pose"
    with pytest.raises(ValueError):
        k.judge(None, [1.0], False)


def test_session():
    s = Session().frame(0, True)
    assert s.phase == "idle"
    s = s.begin(0).predict("squat", 0.9, False).predict("squat", 0.8, False)
    assert s.phase == "counting" and s.set.label == "squat" and s.set.confidence == 0.8
    s = s.frame(100, True, reps=1, warning=True).frame(200, True, reps=2).frame(3300, False, reps=2)
    assert s.phase == "resting" and s.closed == (("squat", False, 2, 1, 0.0, 0, 3300, 3300),)
    s = s.frame(3400, True)
    assert s.phase == "detecting" and s.set_id == 2
    s = s.predict("a", 1, False).predict("b", 1, False)
    assert s.phase == "detecting" and s.streak == 1
    s = s.choose("plank", 4000)
    assert s.phase == "counting" and s.manual == "plank" and len(s.closed) == 1
    assert s.frame(4100, False, hold_ms=1500.0).stop(5000).closed[-1][:2] == ("plank", True)
    rows = [(t, None, None, None, None, t < 4000, t // 1000, 0.0, False, False) for t in range(0, 9000, 100)]
    assert [r[2] for r in drive(SessionKernel(started=True), rows)] == [7]


def test_windows_stream_equals_batch():
    rows = pose_rows(3, drop=((20, 23), (50, 80), (100, 104)))
    whole = sequence_features([r[1] for r in rows], [r[0] for r in rows], 640, 480)
    want = cut_windows(whole)
    k = WindowStream()
    s, got, longest = k.start(), [], 0
    for r in rows:
        s, out = k.step(s, r)
        got += out
        longest = max(longest, len(s["rows"]) + len(s["waiting"]))
    got += k.finish(s)
    assert len(got) == len(want) > 3 and longest <= 60
    for (start, missing, usable, window), (a, b, c) in zip(got, want, strict=True):
        assert start == a and missing == pytest.approx(c) and usable == (c <= 0.3)
        assert np.abs(np.array(window) - b).max() < 1e-12
    assert {u for _, _, u, _ in got} == {True, False} and all(len(w) == LENGTH for *_, w in got)


def test_geometry_properties():
    pose = synthetic_poses(np.array([0.4]))[0]
    base = features_of(pose, 640, 480)
    moved = [None if p is None else p | {"x": p["x"] * 1.7 + 0.2, "y": p["y"] * 1.7 - 0.1} for p in pose]
    assert np.abs(features_of(moved, 640, 480) - base).max() < 1e-9
    assert np.abs(mirrored(mirrored(base)) - base).max() < 1e-15
    assert np.isnan(features_of(None, 1, 1)).all()
    flat = [None if p is None else p | {"x": 0.5, "y": 0.5} for p in pose]
    assert np.isnan(features_of(flat, 640, 480)).all()
    assert nearest_rows(np.array([0.0, 100.0, 134.0]), 15).tolist() == [0, 1, 2]
    x = np.array([[np.nan], [1.0], [np.nan], [3.0], *[[np.nan]] * 6, [9.0], [np.nan]])
    assert np.nan_to_num(fill_gaps(x), nan=-1).ravel().tolist() == [-1, 1, 2, 3, *[-1] * 6, 9, -1]


def test_forms():
    pose = synthetic_poses(np.array([0.0]))[0]
    for i in (11, 23, 27, 12, 24, 28):
        pose[i] = {"x": {11: 0.2, 23: 0.5, 27: 0.8}.get(i, 0.5), "y": {11: 0.5, 23: 0.5, 27: 0.5}.get(i, 0.5), "z": 0.0, "visibility": 0.9 if i in (11, 23, 27) else 0.1}
    plank = BY_LABEL["plank"]
    e = evaluate(pose, plank, 1000, 1000)
    assert e.side == "left" and e.in_position and not e.broken
    pose[23]["y"] = 0.6
    e = evaluate(pose, plank, 1000, 1000)
    assert e.broken == ["plank-hips-low"] and not e.in_position
    assert not evaluate(None, plank, 1, 1).measurable and pose_quality(None, 1, 1) == "no-pose"
    press = BY_LABEL["shoulder_press"]
    e = evaluate(synthetic_poses(np.array([0.0]))[0], press, 1000, 1000)
    kept, failed = judge_cycle({}, e, press, False)
    assert not failed and judge_cycle({"shoulder-press-lockout": 120.0}, e, press, True)[1] == [] or kept
    assert len(CATALOG) == 22


def test_workout_counts_and_closes_sets():
    frames = [(t, None, None, None, None, None, p, w, h) for t, p, w, h in pose_rows(4)]
    end = frames[-1][0]
    rest = [(end + 33 * k, None, None, None, None, None, frames[-1][6], 640, 480) for k in range(1, 200)]
    control = [(0.0, "choose", "squat", None, None, None, None, None, None), (0.0, "start", None, None, None, None, None, None, None)]
    out = drive(Workout(["squat", "plank"]), control + frames + rest)
    kinds = [r[1] for r in out]
    assert kinds.count("rep") == 4 and kinds.count("window") > 5
    closed = [r for r in out if r[1] == "set"]
    assert len(closed) == 1 and closed[0][2] == "squat" and closed[0][3] == 4
    assert [r[4] for r in out if r[1] == "say"][0] == "1"


def test_random_signals_count_exactly():
    rng = random.Random(5)
    for _ in range(40):
        reps, rep_s = rng.randint(1, 7), rng.uniform(0.9, 3)
        t, v = swings(reps, rep_s, 15, amplitude=rng.uniform(0.5, 2), noise=0.005, seed=rng.randint(0, 999))
        assert len(drive(SignalCounter(), list(zip(t, v, strict=True)))) == reps
