"""Scalar and array expressions with explicit missing-value rules.

Missing is NULL everywhere. NaN and infinities are turned into NULL where data comes in (`finite`), because Spark orders
NaN above all numbers and lets greatest/least skip it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(INF)), c)


def present_mean(a: Column, b: Column) -> Column:
    """Mean of what is there; NULL if neither is."""
    return F.coalesce((a + b) / 2, a, b)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL for an undefined ratio."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def arccos_degrees(cosine: Column) -> Column:
    """Clamped to [-1, 1]; the guard keeps NULL from being skipped by greatest and least."""
    return F.when(cosine.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def softmax(scores: Column) -> Column:
    """Shifted by the largest score so that exp cannot overflow."""
    raised = F.transform(scores, lambda v: F.exp(v - F.array_max(scores)))
    total = F.aggregate(raised, F.lit(0.0), lambda s, v: s + v)
    return F.transform(raised, lambda v: v / total)


def ranked(values: Column) -> Column:
    """(value, place) structs, largest first, equal values by place."""
    ordered = F.array_sort(F.transform(values, lambda v, i: F.struct((-v).alias("n"), i.alias("place"))))
    return F.transform(ordered, lambda x: F.struct((-x["n"]).alias("value"), x["place"].alias("place")))


def verdict(probabilities: Column, labels: Column, poor: Column, min_confidence: float = 0.65, min_margin: float = 0.45) -> Column:
    """struct(label, confidence, margin, uncertain, reason); reasons in order of weight: poor-pose, low-confidence, close-call."""
    top = ranked(probabilities)
    best, second = F.get(top, F.lit(0)), F.get(top, F.lit(1))
    margin = best["value"] - F.coalesce(second["value"], F.lit(0.0))
    reason = F.when(poor, "poor-pose").when(best["value"] < min_confidence, "low-confidence").when(margin < min_margin, "close-call")
    return F.struct(F.get(labels, best["place"]).alias("label"), best["value"].alias("confidence"), margin.alias("margin"), reason.isNotNull().alias("uncertain"), reason.alias("reason"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def snake_case(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.[^.]*$", "")


def group_name(number: Column) -> Column:
    return F.format_string("g%04d", number)


# Fixed values of the 32-bit FNV-1a hash.
FNV_BASIS, FNV_PRIME, FNV_MASK = 2166136261, 16777619, 4294967295


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units, as a long."""
    units = F.split(F.regexp_replace(F.hex(F.encode(text, "UTF-16BE")), "(.{4})", "$1 "), " ")
    numbers = F.transform(F.filter(units, lambda u: u != ""), lambda u: F.conv(u, 16, 10).cast("long"))
    return F.aggregate(numbers, F.lit(FNV_BASIS).cast("long"), lambda h, u: (h.bitwiseXOR(u) * FNV_PRIME).bitwiseAND(F.lit(FNV_MASK).cast("long")))


def int_or_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit("")).try_cast("bigint")


def int_list(text: Column) -> Column:
    """`;`-joined integers, blanks skipped; an element that is none is NULL."""
    return F.transform(F.filter(F.split(text, ";"), lambda p: F.trim(p) != ""), lambda p: F.trim(p).try_cast("bigint"))


def rises(values: Column) -> Column:
    """Strictly ascending."""
    n = F.greatest(F.size(values) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(values, F.lit(2), n), F.slice(values, F.lit(1), n), lambda b, a: b <= a)
    return ~F.exists(pairs, lambda x: x)


def is_iso_time(text: Column) -> Column:
    return F.try_to_timestamp(text).isNotNull()


def frame_millis(index: Column, fps: Column) -> Column:
    """Half to even, as the recorder of frame times rounds."""
    return F.bround(index * 1000 / fps).cast("long")


def fit_within(width: Column, height: Column, most: int) -> Column:
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    side = lambda v: F.greatest(F.lit(1), F.bround(v * scale).cast("int"))
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def duration_text(ms: Column) -> Column:
    seconds = F.floor(ms / 1000)
    return F.format_string("%d:%02d", F.floor(seconds / 60), seconds % 60)


def frame_step(fps: Column) -> Column:
    return F.lit(1000.0) / F.when(fps > 0, fps).otherwise(F.lit(30.0))


def next_speed(speed: Column, direction: Column, speeds: tuple[float, ...] = (0.5, 1.0, 2.0)) -> Column:
    steps = F.array(*[F.lit(s) for s in speeds])
    at = F.array_position(steps, speed)
    at = F.when(at == 0, F.lit(speeds.index(1.0) + 1)).otherwise(at)
    return F.element_at(steps, F.greatest(F.lit(1), F.least(F.lit(len(speeds)), at + direction)).cast("int"))


def dominant_side(left: Column, right: Column, margin: float = 0.05) -> Column:
    return F.when(left.isNull() | right.isNull(), "unknown").when(F.abs(left - right) < margin, "balanced").when(left > right, "left").otherwise("right")


def rounded_json(values: Column, decimals: int) -> Column:
    """A JSON array of rounded numbers in which missing and non-finite ones are null."""
    return F.to_json(F.transform(values, lambda v: F.round(finite(v), decimals)), {"ignoreNullFields": "false"})


def task_of(label: Column, holds: tuple[str, ...] = ("plank",)) -> Column:
    return F.when(label.isin(*holds), "hold").otherwise("reps")


def breaks(value: Column, low: Column, high: Column) -> Column:
    """Outside a limit; a missing value or limit never breaks."""
    return F.coalesce(value > high, F.lit(False)) | F.coalesce(value < low, F.lit(False))


def keep_frame(index: Column, source_fps: Column, most_fps: float, tolerance: float = 1.01) -> Column:
    """Frames to keep so that at most `most_fps` are left."""
    r = F.lit(most_fps) / source_fps
    return (source_fps <= most_fps * tolerance) | (index == 0) | (F.floor(index * r) != F.floor((index - 1) * r))


def set_badge(reps: Column, warned: Column) -> Column:
    return F.format_string("%d/%d", reps - F.coalesce(warned, F.lit(0)), reps)
