"""Declarative form rules as a table, and their evaluation by columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.functions.geometry import angle, angle_from_vertical, height_above, line_offset, to_pixel
from cadence.functions.scalars import breaks, finite
from cadence.kernels.forms import CATALOG, NAMED, RULES, SEEN


def rules_table(spark: SparkSession) -> DataFrame:
    """One row per rule: a small table by its nature, joined by label."""
    rows = [(s.label, s.view, list(s.side_points), k, r.id, r.kind, list(r.points), r.low, r.high, r.per, r.message) for s in RULES for k, r in enumerate(s.rules)]
    return spark.createDataFrame(rows, "label string, view string, side_points array<string>, place int, rule_id string, kind string, points array<string>, low double, high double, per string, message string")


def catalog_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*c[:3], "experimental", c[3]) for c in CATALOG], "label string, name string, task string, status string, note string")


def with_names(df: DataFrame, label: str = "label") -> DataFrame:
    """Display names from the catalog; a label that it lacks is its own name."""
    names = catalog_table(df.sparkSession).select(F.col("label").alias("_l"), F.col("name").alias("_n"))
    return df.join(F.broadcast(names), F.col(label) == F.col("_l"), "left").withColumn("name", F.coalesce("_n", label)).drop("_l", "_n")


def _visibility(pose: Column, name: Column, side: int) -> Column:
    numbers = F.create_map(*[x for n, pair in NAMED.items() for x in (F.lit(n), F.lit(pair[side]))])
    return F.coalesce(finite(F.get(pose, numbers[name])["visibility"]), F.lit(0.0))


def seen_side(pose: Column, names: Column) -> Column:
    """left or right: the side whose least visible point is seen better, NULL if neither is seen."""
    left, right = _least(pose, names, 0), _least(pose, names, 1)
    return F.when((left >= right) & (left >= SEEN), "left").when((right > left) & (right >= SEEN), "right")


def _least(pose: Column, names: Column, side: int) -> Column:
    return F.array_min(F.transform(names, lambda n: _visibility(pose, n, side)))


def evaluate_rules(frames: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """frames(key columns, label, pose, width, height) by rule: side, value, broken. Frames that cannot be measured, and rules
    with a point that is not seen, have no value and break nothing."""
    rules = rules_table(frames.sparkSession) if rules is None else rules
    joined = frames.join(F.broadcast(rules), "label")
    pose, points = F.col("pose"), F.col("points")
    numbers = F.create_map(*[x for n, pair in NAMED.items() for x in (F.lit(n), F.array(F.lit(pair[0]), F.lit(pair[1])))])
    side = seen_side(pose, F.col("side_points"))
    out = joined.withColumn("side", side).withColumn("_s", F.when(F.col("side") == "left", 0).when(F.col("side") == "right", 1))
    mark = lambda name: F.get(pose, F.get(numbers[name], F.col("_s")))
    at = lambda k: to_pixel(mark(F.get(points, F.lit(k))), F.col("width"), F.col("height"))
    named = lambda n: to_pixel(mark(F.lit(n)), F.col("width"), F.col("height"))
    shoulder, hip = named("shoulder"), named("hip")
    torso = F.hypot(shoulder[0] - hip[0], shoulder[1] - hip[1])
    seen = F.forall(points, lambda n: F.coalesce(finite(mark(n)["visibility"]), F.lit(0.0)) >= SEEN)
    kind = F.col("kind")
    value = F.when(kind == "angle", angle(at(0), at(1), at(2))).when(kind == "angleFromVertical", angle_from_vertical(at(0), at(1))).when(kind == "heightAbove", height_above(at(0), at(1), torso)).when(kind == "lineOffset", line_offset(at(0), at(1), at(2)))
    measured = out.withColumn("value", F.when(F.col("_s").isNotNull() & seen, value))
    return measured.withColumn("broken", (F.col("per") == "frame") & breaks(F.col("value"), F.col("low"), F.col("high"))).drop("_s")


def frame_verdicts(evaluated: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, broken ids, in_position): in position where all rules have values and none is broken."""
    broken = F.array_sort(F.collect_list(F.when(F.col("broken"), F.col("rule_id"))))
    return evaluated.groupBy(*keys).agg(broken.alias("broken"), F.bool_and(F.col("value").isNotNull() & ~F.col("broken")).alias("in_position"))


def cycle_verdicts(evaluated: DataFrame, keys: list[str], order: str, finished: Column) -> DataFrame:
    """(keys, rule_id, cycle, extreme, failed) of rules that are judged once per repetition, on their best value in it."""
    w = Window.partitionBy(*keys, "rule_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    part = evaluated.where("per = 'rep'").withColumn("_f", F.coalesce(finished, F.lit(False)).cast("int")).withColumn("cycle", F.coalesce(F.sum("_f").over(w), F.lit(0)))
    best = part.groupBy(*keys, "rule_id", "cycle", "low", "high").agg(F.max("value").alias("_max"), F.min("value").alias("_min"), F.max("_f").alias("_done")).where("_done = 1")
    extreme = F.when(F.col("low").isNotNull(), F.col("_max")).otherwise(F.col("_min"))
    return best.withColumn("extreme", extreme).select(*keys, "rule_id", "cycle", "extreme", breaks(extreme, F.col("low"), F.col("high")).alias("failed"))


def measure_exercise(frames: DataFrame, joint: list[str], lean: float | None = None, line: tuple[list[str], float] | None = None) -> DataFrame:
    """`angle` of a joint on the better seen side, and `warnings` for a leaning torso or a bent body line."""
    side = seen_side(F.col("pose"), F.array(*[F.lit(n) for n in joint]))
    out = frames.withColumn("_s", F.when(side == "left", 0).when(side == "right", 1))
    at = lambda n: to_pixel(F.get(F.col("pose"), F.when(F.col("_s") == 0, NAMED[n][0]).otherwise(NAMED[n][1])), F.col("width"), F.col("height"))
    known = F.col("_s").isNotNull()
    warnings = []
    if lean is not None:
        warnings.append(F.when(known & (angle_from_vertical(at("shoulder"), at("hip")) > lean), "torso-lean"))
    if line is not None:
        warnings.append(F.when(known & (angle(*[at(n) for n in line[0]]) < line[1]), "body-line"))
    return out.withColumns({"angle": F.when(known, angle(*[at(n) for n in joint])), "warnings": F.array_compact(F.array(*warnings)) if warnings else F.array().cast("array<string>")}).drop("_s")


def pose_quality(frames: DataFrame, names: tuple[str, ...] = ("shoulder", "hip"), view: str = "any") -> DataFrame:
    """`quality`: no-pose, partial, frontal, or NULL for a pose that can be judged."""
    side = seen_side(F.col("pose"), F.array(*[F.lit(n) for n in names]))
    k = F.when(side == "left", 0).otherwise(1)
    at = lambda n, s: to_pixel(F.get(F.col("pose"), F.get(F.array(F.lit(NAMED[n][0]), F.lit(NAMED[n][1])), s)), F.col("width"), F.col("height"))
    (sx, sy), (hx, hy) = at("shoulder", k), at("hip", k)
    torso = F.hypot(sx - hx, sy - hy)
    wide = F.abs(at("shoulder", F.lit(0))[0] - at("shoulder", F.lit(1))[0])
    frontal = F.lit(view == "side") & (torso > 0) & (F.try_divide(wide, torso) > 0.55)
    return frames.withColumn("quality", F.when(F.col("pose").isNull(), "no-pose").when(side.isNull(), "partial").when(frontal, "frontal"))
