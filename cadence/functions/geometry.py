"""Body geometry on poses: arrays of landmark structs (x, y, z, visibility), NULL where no pose was found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadence.functions.scalars import arccos_degrees, finite, present_mean

# The landmarks that are kept, in feature order (nose; left and right shoulder, elbow, wrist, hip, knee, ankle).
KEPT = (0, 11, 12, 13, 14, 15, 16, 23, 24, 25, 26, 27, 28)
# Fixed values: (end, corner, end) of the eight joint angles, as places in KEPT: elbows, shoulders, hips, knees.
ANGLES = ((1, 3, 5), (2, 4, 6), (3, 1, 7), (4, 2, 8), (1, 7, 9), (2, 8, 10), (7, 9, 11), (8, 10, 12))
SHOULDERS, HIPS = (1, 2), (7, 8)
POINTS, JOINTS = len(KEPT), len(ANGLES)
FEATURES = 3 * POINTS + JOINTS
MIN_SCALE = 1e-6
#: Where each feature of a mirrored row comes from, and its sign: sides swap, x changes sign.
_SWAP = [0] + [p + 1 if p % 2 else p - 1 for p in range(1, POINTS)]
MIRROR = [3 * _SWAP[p] + k for p in range(POINTS) for k in range(3)] + [3 * POINTS + (a ^ 1) for a in range(JOINTS)]
SIGN = [-1.0 if k == 0 else 1.0 for _ in range(POINTS) for k in range(3)] + [1.0] * JOINTS
#: Columns that move: x and y of every point, and the angles.
MOTION = [3 * p + k for p in range(POINTS) for k in range(2)] + list(range(3 * POINTS, FEATURES))


def angle(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column]) -> Column:
    """Degrees at b between a and c; NULL where a point is missing or coincides with b."""
    ux, uy, vx, vy = a[0] - b[0], a[1] - b[1], c[0] - b[0], c[1] - b[1]
    length = F.hypot(ux, uy) * F.hypot(vx, vy)
    return arccos_degrees(F.try_divide(ux * vx + uy * vy, F.nullif(length, F.lit(0.0))))


def angle_from_vertical(top: tuple[Column, Column], bottom: tuple[Column, Column]) -> Column:
    return F.degrees(F.atan2(F.abs(top[0] - bottom[0]), F.abs(top[1] - bottom[1])))


def line_offset(a: tuple[Column, Column], p: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """How far p lies below the line a - b, in lengths of that line; NULL for an upright line."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    on_line = a[1] + F.try_divide(dy * (p[0] - a[0]), dx)
    return F.when(F.abs(dx) >= 1e-9, F.try_divide(p[1] - on_line, F.hypot(dx, dy)))


def height_above(p: tuple[Column, Column], reference: tuple[Column, Column], torso: Column) -> Column:
    return F.when(torso > 0, F.try_divide(reference[1] - p[1], torso))


def to_pixel(landmark: Column, width: Column, height: Column) -> tuple[Column, Column]:
    return finite(landmark["x"]) * width, finite(landmark["y"]) * height


def no_pose(pose: Column) -> Column:
    """Not a single coordinate is there."""
    return ~F.coalesce(F.exists(pose, lambda p: finite(p["x"]).isNotNull() | finite(p["y"]).isNotNull()), F.lit(False))


def fully_seen(pose: Column) -> Column:
    """All x are there: the measure of a detection rate."""
    return F.coalesce(F.forall(pose, lambda p: finite(p["x"]).isNotNull()), F.lit(False))


def any_visibility(pose: Column) -> Column:
    return F.coalesce(F.exists(pose, lambda p: finite(p["visibility"]).isNotNull()), F.lit(False))


def visible_count(pose: Column, least: float = 0.5) -> Column:
    return F.size(F.filter(F.coalesce(pose, F.array().cast("array<struct<x:double,y:double,z:double,visibility:double>>")), lambda p: F.coalesce(finite(p["visibility"]), F.lit(0.0)) >= least))


def select_landmarks(pose: Column, width: Column, height: Column) -> Column:
    """array<double> of x (times the aspect ratio), y and visibility of the kept landmarks."""
    aspect = width.cast("double") / height
    at = lambda i, f: finite(F.get(pose, F.lit(i))[f].cast("double"))
    return F.array(*[v for i in KEPT for v in (at(i, "x") * aspect, at(i, "y"), at(i, "visibility"))])


def _xy(points: Column, p: int) -> tuple[Column, Column]:
    return F.get(points, F.lit(3 * p)), F.get(points, F.lit(3 * p + 1))


def bound(value: Column, f) -> Column:
    """f(value), with the value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def normalize_points(points: Column) -> Column:
    """Centred between the hips and divided by the mean torso length; all NULL where that is undefined or tiny."""

    def scaled(p: Column) -> Column:
        (lx, ly), (rx, ry) = (_xy(p, h) for h in HIPS)
        torso = [F.hypot(_xy(p, s)[0] - _xy(p, h)[0], _xy(p, s)[1] - _xy(p, h)[1]) for s, h in zip(SHOULDERS, HIPS, strict=True)]
        frame = F.struct(present_mean(lx, rx).alias("x"), present_mean(ly, ry).alias("y"), present_mean(*torso).alias("scale"))

        def placed(f: Column) -> Column:
            usable = (f["scale"] >= MIN_SCALE) & f["x"].isNotNull() & f["y"].isNotNull()
            moved = lambda v, i: F.when(i % 3 == 0, F.try_divide(v - f["x"], f["scale"])).when(i % 3 == 1, F.try_divide(v - f["y"], f["scale"])).otherwise(v)
            return F.transform(p, lambda v, i: F.when(usable, moved(v, i)))

        return bound(frame, placed)

    return bound(points, scaled)


def joint_angles(points: Column) -> Column:
    """The eight joint angles over 180."""
    corner = lambda p, k: angle(*(_xy(p, n) for n in ANGLES[k])) / 180
    return bound(points, lambda p: F.array(*[corner(p, k) for k in range(JOINTS)]))


def frame_features(points: Column) -> Column:
    return bound(points, lambda p: F.concat(p, joint_angles(p)))


def motion_vector(features: Column) -> Column:
    """What moves, or NULL if any of it is missing."""
    pick = lambda f: F.transform(F.array(*[F.lit(i) for i in MOTION]), lambda i: F.get(f, i))
    return bound(bound(features, pick), lambda m: F.when(~F.exists(m, lambda v: v.isNull()), m))


def mirror(features: Column) -> Column:
    """Left and right swapped."""
    source = F.array(*[F.lit(i) for i in MIRROR])
    sign = F.array(*[F.lit(s) for s in SIGN])
    return bound(features, lambda f: F.zip_with(source, sign, lambda i, s: F.get(f, i) * s))


def row_missing(features: Column) -> Column:
    return F.exists(features, lambda v: v.isNull())
