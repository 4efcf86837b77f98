"""Declarative form rules on poses: the catalog of exercises, the rule sets, and their evaluation."""

from __future__ import annotations

import math
from dataclasses import dataclass

from cadence.kernels.base import Kernel, is_number

# Landmark numbers (left, right) of the named points.
NAMED = {"ear": (7, 8), "shoulder": (11, 12), "elbow": (13, 14), "wrist": (15, 16), "hip": (23, 24), "knee": (25, 26), "ankle": (27, 28)}
SEEN = 0.5
FRONTAL = 0.55


@dataclass(frozen=True)
class Rule:
    id: str
    kind: str
    points: tuple[str, ...]
    low: float | None
    high: float | None
    message: str
    per: str = "frame"


@dataclass(frozen=True)
class RuleSet:
    label: str
    view: str
    side_points: tuple[str, ...]
    rules: tuple[Rule, ...]


# The rule sets by exercise.
RULES = (
    RuleSet("squat", "side", ("hip", "knee", "ankle"), (Rule("squat-torso-lean", "angleFromVertical", ("shoulder", "hip"), None, 45.0, "Punggung terlalu membungkuk"),)),
    RuleSet("push_up", "side", ("shoulder", "elbow", "wrist"), (Rule("push-up-body-line", "angle", ("shoulder", "hip", "ankle"), 160.0, None, "Jaga badan tetap lurus"),)),
    RuleSet("barbell_biceps_curl", "side", ("shoulder", "elbow", "wrist", "hip"), (Rule("curl-elbow-forward", "angle", ("elbow", "shoulder", "hip"), None, 30.0, "Siku jangan maju — jaga lengan atas di samping badan"),)),
    RuleSet("lateral_raise", "any", ("shoulder", "elbow", "wrist", "hip"), (Rule("lateral-raise-too-high", "heightAbove", ("wrist", "shoulder"), None, 0.15, "Jangan angkat tangan melewati bahu"),)),
    RuleSet("deadlift", "side", ("ear", "shoulder", "hip", "knee"), (Rule("deadlift-rounded-back", "angle", ("ear", "shoulder", "hip"), 150.0, None, "Jaga punggung tetap lurus"),)),
    RuleSet("shoulder_press", "any", ("shoulder", "elbow", "wrist"), (Rule("shoulder-press-lockout", "angle", ("shoulder", "elbow", "wrist"), 160.0, None, "Luruskan lengan penuh di atas kepala", "rep"),)),
    RuleSet("plank", "side", ("shoulder", "hip", "ankle"), (Rule("plank-hips-low", "lineOffset", ("shoulder", "hip", "ankle"), None, 0.1, "Pinggul turun — kencangkan perut"), Rule("plank-hips-high", "lineOffset", ("shoulder", "hip", "ankle"), -0.12, None, "Pinggul terlalu tinggi"))),
)
BY_LABEL = {r.label: r for r in RULES}

# Labels with their display name, task and note; all are marked experimental.
CATALOG = (
    ("barbell_biceps_curl", "Barbell biceps curl", "reps", None),
    ("bench_press", "Bench press", "reps", "Posisi berbaring: deteksi pose lebih lemah"),
    ("chest_fly_machine", "Chest fly (mesin)", "reps", None),
    ("deadlift", "Deadlift", "reps", None),
    ("decline_bench_press", "Decline bench press", "reps", "Data sedikit dan deteksi pose terlemah"),
    ("hammer_curl", "Hammer curl", "reps", None),
    ("hip_thrust", "Hip thrust", "reps", None),
    ("incline_bench_press", "Incline bench press", "reps", None),
    ("lat_pulldown", "Lat pulldown", "reps", None),
    ("lateral_raise", "Lateral raise", "reps", None),
    ("leg_extension", "Leg extension", "reps", None),
    ("leg_raises", "Leg raise", "reps", None),
    ("plank", "Plank", "hold", "Hanya 7 video di dataset"),
    ("pull_up", "Pull-up", "reps", None),
    ("push_up", "Push-up", "reps", None),
    ("romanian_deadlift", "Romanian deadlift", "reps", None),
    ("russian_twist", "Russian twist", "reps", "Gerakan rotasi sulit diukur dari sudut 2D"),
    ("shoulder_press", "Shoulder press", "reps", None),
    ("squat", "Squat", "reps", None),
    ("t_bar_row", "T-bar row", "reps", None),
    ("tricep_dips", "Tricep dips", "reps", None),
    ("tricep_pushdown", "Tricep pushdown", "reps", None),
)
HOLDS = frozenset(label for label, _, task, _ in CATALOG if task == "hold")


def _corner(a, b, c):
    u, v = (a[0] - b[0], a[1] - b[1]), (c[0] - b[0], c[1] - b[1])
    size = math.hypot(*u) * math.hypot(*v)
    return None if not size > 0 else math.degrees(math.acos(max(-1.0, min(1.0, (u[0] * v[0] + u[1] * v[1]) / size))))


def _offset(a, p, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    return None if abs(dx) < 1e-9 else (p[1] - a[1] - dy * (p[0] - a[0]) / dx) / math.hypot(dx, dy)


#: Measures by kind: (points, torso length) to a value or None. New kinds are added here.
MEASURES = {
    "angle": lambda p, torso: _corner(*p),
    "angleFromVertical": lambda p, torso: math.degrees(math.atan2(abs(p[0][0] - p[1][0]), abs(p[0][1] - p[1][1]))),
    "heightAbove": lambda p, torso: (p[1][1] - p[0][1]) / torso if torso > 0 else None,
    "lineOffset": lambda p, torso: _offset(*p),
}


def broken(rule: Rule, value: float | None) -> bool:
    return is_number(value) and (rule.high is not None and value > rule.high or rule.low is not None and value < rule.low)


@dataclass(frozen=True)
class Evaluation:
    measurable: bool
    side: str | None
    values: tuple[tuple[Rule, float | None], ...] = ()

    @property
    def broken(self) -> list[str]:
        return [r.id for r, v in self.values if r.per == "frame" and broken(r, v)]

    @property
    def in_position(self) -> bool:
        return self.measurable and all(is_number(v) and not (r.per == "frame" and broken(r, v)) for r, v in self.values)

    @property
    def checked(self) -> bool:
        return any(is_number(v) for _, v in self.values)


def _landmark(pose, i: int):
    p = pose[i] if i < len(pose) else None
    if p is None:
        return (math.nan, math.nan, 0.0)
    x, y, v = (p["x"], p["y"], p["visibility"]) if isinstance(p, dict) else (p[0], p[1], p[3])
    number = lambda a: math.nan if a is None else a
    return number(x), number(y), v if is_number(v) else 0.0


def better_side(pose, names) -> int | None:
    """0 for left, 1 for right: the side whose least visible point is seen better, left if equal; None if neither is seen."""
    seen = [min(_landmark(pose, NAMED[n][k])[2] for n in names) for k in (0, 1)]
    k = 0 if seen[0] >= seen[1] else 1
    return k if seen[k] >= SEEN else None


def evaluate(pose, rules: RuleSet | None, width: float, height: float) -> Evaluation:
    """Values of all rules on the better seen side; a rule with a point that is not seen has none."""
    side = None if pose is None or rules is None else better_side(pose, rules.side_points)
    if side is None:
        return Evaluation(False, None)
    at = lambda n: (_landmark(pose, NAMED[n][side])[0] * width, _landmark(pose, NAMED[n][side])[1] * height)
    torso = math.dist(at("shoulder"), at("hip"))
    values = []
    for r in rules.rules:
        seen = all(_landmark(pose, NAMED[n][side])[2] >= SEEN for n in r.points)
        v = MEASURES[r.kind]([at(n) for n in r.points], torso) if seen else None
        values.append((r, v if is_number(v) else None))
    return Evaluation(True, ("left", "right")[side], tuple(values))


def judge_cycle(extremes: dict, evaluation: Evaluation, rules: RuleSet | None, finished: bool) -> tuple[dict, list[Rule]]:
    """Rules judged once per repetition, on the most favourable value seen in it."""
    per_rep = [r for r in (rules.rules if rules else ()) if r.per == "rep"]
    now, kept = dict((r.id, v) for r, v in evaluation.values), dict(extremes)
    for r in per_rep:
        v = now.get(r.id)
        if v is not None:
            better = max if r.low is not None else min
            kept[r.id] = better(kept[r.id], v) if r.id in kept else v
    return ({}, [r for r in per_rep if r.id in kept and broken(r, kept[r.id])]) if finished else (kept, [])


def pose_quality(pose, width: float, height: float, points=("shoulder", "hip"), view: str = "any") -> str | None:
    """no-pose, partial, frontal, or None for a pose that can be judged."""
    if pose is None:
        return "no-pose"
    side = better_side(pose, points)
    if side is None:
        return "partial"
    if view != "side":
        return None
    at = lambda n, k: (_landmark(pose, NAMED[n][k])[0] * width, _landmark(pose, NAMED[n][k])[1] * height)
    torso = math.dist(at("shoulder", side), at("hip", side))
    return "frontal" if torso > 0 and abs(at("shoulder", 0)[0] - at("shoulder", 1)[0]) / torso > FRONTAL else None


class FormKernel(Kernel):
    """(ts_ms, side, broken, in_position, checked) of one exercise's rules per frame."""

    inputs = ("ts_ms", "pose", "width", "height")
    output = "ts_ms double, side string, broken array<string>, in_position boolean, checked boolean"

    def __init__(self, label: str) -> None:
        self.rules = BY_LABEL.get(label)

    def start(self):
        return None

    def step(self, s, row):
        t, pose, width, height = row
        e = evaluate(pose, self.rules, width, height)
        return s, [(float(t), e.side, e.broken, e.in_position, e.checked)]
