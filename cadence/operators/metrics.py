"""Classification and counting metrics as relational queries."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.functions.scalars import ratio
from cadence.session import cut


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, mean): the mean of each component."""
    each = df.select(key, F.posexplode(vector).alias("_p", "_v")).groupBy(key, "_p").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda x: x["_m"]).alias("mean"))


def confusion(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """(true, predicted, n, share): counts, and their share of the true label's rows."""
    n = df.groupBy(F.col(true).alias("true"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("true")))


def worst_mistakes(df: DataFrame, true: str, predicted: str, top: int) -> DataFrame:
    """The most frequent directed mistakes."""
    return confusion(df, true, predicted).where(F.col("true") != F.col("predicted")).orderBy(F.desc("n"), F.col("true"), F.col("predicted")).limit(top)


def f1_report(df: DataFrame, true: str, predicted: str, labels: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, support, precision, recall, f1) for every row of labels(label); undefined measures are 0."""
    hit = (F.col(true) == F.col(predicted)).cast("long")
    by_true = df.groupBy(F.col(true).alias("_t")).agg(F.sum(hit).alias("tp"), F.count("*").alias("support"))
    by_predicted = df.groupBy(F.col(predicted).alias("_p")).agg(F.count("*").alias("claimed"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = labels.join(by_true, labels["label"] == by_true["_t"], "left").join(by_predicted, labels["label"] == by_predicted["_p"], "left")
    counts = joined.select("label", zero("tp").alias("tp"), (zero("claimed") - zero("tp")).alias("fp"), (zero("support") - zero("tp")).alias("fn"), zero("support").alias("support"))
    part = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": part(tp, tp + fp), "recall": part(tp, tp + fn), "f1": part(2 * tp, 2 * tp + fp + fn)})


def overall(df: DataFrame, true: str, predicted: str, labels: DataFrame) -> DataFrame:
    """(n, accuracy, macro_f1): the mean F1 counts every label, also absent ones."""
    accuracy = df.agg(F.count("*").alias("n"), F.avg((F.col(true) == F.col(predicted)).cast("double")).alias("accuracy"))
    macro = f1_report(df, true, predicted, labels).agg(F.avg("f1").alias("macro_f1"))
    return accuracy.join(macro, F.lit(True))


def first_label(df: DataFrame, key: str, label: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(label, order).alias(label))


def sweep(scored: DataFrame, score: str, right: str, cuts: list[float], target: float) -> DataFrame:
    """(cut, kept, coverage, accuracy, chosen): what stays at each cut, and the smallest cut that meets the target accuracy;
    if none does, the last cut that keeps anything. Rows are counted by the number of cuts they reach before the cuts are told
    apart, so no row is multiplied."""
    steps = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))])
    right_n = F.count_if(F.col(right).cast("boolean"))
    levels = scored.groupBy(F.size(F.filter(steps, lambda c: F.col(score) >= c)).alias("level")).agg(F.count("*").alias("n"), right_n.alias("right"), F.count(right).alias("judged"))
    rows = levels.agg(F.sum("n").alias("total"))
    reached = levels.where("level > 0").select(F.explode(F.slice(steps, F.lit(1), F.col("level"))).alias("cut"), "n", "right", "judged")
    kept = reached.groupBy("cut").agg(F.sum("n").alias("kept"), ratio(F.sum("right"), F.sum("judged")).alias("accuracy"))
    out = kept.join(rows, F.lit(True)).select("cut", "kept", ratio(F.col("kept"), F.col("total")).alias("coverage"), "accuracy")
    every = Window.partitionBy(F.lit(1))
    meets = F.min(F.when(F.col("accuracy") >= target, F.col("cut"))).over(every)
    return out.withColumn("chosen", F.col("cut") == F.coalesce(meets, F.max("cut").over(every)))


def class_weights(df: DataFrame, label: str, labels: DataFrame) -> DataFrame:
    """(label, n, weight): total / (labels present * n); 0 for absent labels."""
    n = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(1))
    joined = labels.join(n, labels["label"] == n["_l"], "left").withColumns({"_sum": F.sum("n").over(every), "_kinds": F.count("n").over(every)})
    return joined.select("label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(ratio(F.col("_sum"), F.col("_kinds") * F.col("n")), F.lit(0.0)).alias("weight"))


def within(predicted: DataFrame, truth: DataFrame, key: str, p: str, t: str, tolerance: float) -> DataFrame:
    """(key, p, t, distance): pairs at most `tolerance` apart. Times fall into buckets of that width and each truth meets
    its own and the two next to it, so the join is an equi-join however long the series of a key are."""
    width = F.lit(float(max(tolerance, 1)))
    left = predicted.select(key, F.col(p).alias("p"), F.floor(F.col(p) / width).alias("_b"))
    right = truth.select(F.col(key).alias("_k"), F.col(t).alias("t"), F.explode(F.array(*[F.floor(F.col(t) / width) + d for d in (-1, 0, 1)])).alias("_c"))
    met = left.join(right, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_c"))).select(key, "p", "t", F.abs(F.col("p") - F.col("t")).alias("distance"))
    return met.where(F.col("distance") <= tolerance)


def count_metrics(df: DataFrame, predicted: str = "predicted", truth: str = "truth", matched: str = "matched") -> DataFrame:
    """Adds error, abs_error, off_by_one, normalized_error, precision and recall to per-video counts; undefined ratios are NULL."""
    p, t, m = F.col(predicted), F.col(truth), F.col(matched)
    return df.withColumns({"error": p - t, "abs_error": F.abs(p - t), "off_by_one": F.abs(p - t) <= 1, "normalized_error": ratio(F.abs(p - t), t), "precision": ratio(m, p), "recall": ratio(m, t)})


def pooled(scored: DataFrame, by: str, ambiguous: Column | None = None) -> DataFrame:
    """Per group and in total: errors averaged over videos, precision and recall pooled over their marks.
    `scope` is the group, NULL in the total; with `ambiguous`, `clean_mae` leaves such videos out."""
    clean = F.lit(True) if ambiguous is None else ~F.coalesce(ambiguous, F.lit(False))
    sets = scored.withColumn("scope", F.col(by)).rollup("scope").agg(
        F.grouping("scope").cast("int").alias("is_total"),
        F.count("*").alias("videos"),
        F.avg("abs_error").alias("mae"),
        F.avg(F.when(clean, F.col("abs_error"))).alias("clean_mae"),
        F.avg(F.col("off_by_one").cast("double")).alias("obo"),
        F.sum("matched").alias("m"),
        F.sum("predicted").alias("p"),
        F.sum("truth").alias("t"),
    )
    return sets.select("scope", "is_total", "videos", "mae", "clean_mae", "obo", ratio(F.col("m"), F.col("p")).alias("precision"), ratio(F.col("m"), F.col("t")).alias("recall"))


#: Cells of a pass over the values, and rows of a cell that are put in order on the driver.
CELLS, FEW = 4096, 50_000


def nth_values(df: DataFrame, value: str, ranks: list[int]) -> dict[int, float]:
    """The values of the given ranks (from 0) among finite doubles, without putting them in order: counts per cell of
    [least, greatest] tell which cell holds a rank, and only that cell is looked into, until it has one value or few rows.
    `df` is read once a pass, of which each divides the range by CELLS."""
    found: dict[int, float] = {}
    todo = [(df, 0, sorted(set(ranks)))]
    while todo:
        part, before, wanted = todo.pop()
        n, low, high = part.agg(F.count("*"), F.min(value), F.max(value)).first()
        if low == high:
            found |= {r: low for r in wanted}
            continue
        if n <= FEW:
            ordered = sorted(r[0] for r in part.select(value).collect())
            found |= {r: ordered[r - before] for r in wanted}
            continue
        # Halved where the range of the doubles is not finite otherwise; the last cell is closed above.
        half = 1.0 if high - low < float("inf") else 0.5
        share = (F.col(value) * half - F.lit(low * half)) / F.lit(high * half - low * half)
        cell = F.least(F.floor(share * CELLS), F.lit(CELLS - 1))
        for c, count in sorted(tuple(r) for r in part.groupBy(cell.alias("c")).count().collect()):
            inside = [r for r in wanted if before <= r < before + count]
            if inside:
                todo.append((part.where(cell == c), before, inside))
            before += count
    return found


def describe(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, median, p95 (linear), mean and max of finite values; exact. Over all rows no task holds more than a cell of them;
    with `by`, a group's distinct values meet in one task."""
    fine = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value)) < float("inf")))
    if by:
        q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95)))
        out = fine.groupBy(*by).agg(F.count("*").alias("n"), q.alias("_q"), F.avg(value).alias("mean"), F.max(value).alias("max"))
        return out.select(*by, "n", F.get("_q", F.lit(0)).alias("median"), F.get("_q", F.lit(1)).alias("p95"), "mean", "max")
    own = cut(fine.select(F.col(value), F.col(value).cast("double").alias("_v")))
    out = own.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    n = own.count()
    ends = {q: (int((n - 1) * q), min(int((n - 1) * q) + 1, n - 1)) for q in (0.5, 0.95)} if n else {}
    at = nth_values(own.select("_v"), "_v", [r for pair in ends.values() for r in pair]) if n else {}
    line = lambda q: F.lit(at[ends[q][0]] + (at[ends[q][1]] - at[ends[q][0]]) * ((n - 1) * q - ends[q][0]) if n else None).cast("double")
    return out.select("n", line(0.5).alias("median"), line(0.95).alias("p95"), "mean", "max")


def throughput(df: DataFrame, key: str, time: str) -> DataFrame:
    """(key, fps): intervals per second between the first and the last row."""
    span = df.groupBy(key).agg(F.count("*").alias("n"), (F.max(time) - F.min(time)).alias("span"))
    return span.select(key, ratio((F.col("n") - 1) * 1000, F.nullif(F.col("span"), F.lit(0))).alias("fps"))


def parameter_grid(spark: SparkSession, grid: dict[str, list[float]]) -> DataFrame:
    """All combinations, numbered in the order in which the last parameter varies fastest."""
    rows = [(k, *map(float, c)) for k, c in enumerate(product(*grid.values()))]
    return spark.createDataFrame(rows, "params int, " + ", ".join(f"{n} double" for n in grid))


def hysteresis_grid(df: DataFrame, key: str, order: list[str], value: str, truth: Column, grid: list[tuple[float, float]]) -> DataFrame:
    """(params, key, counted, abs_error): returns from `low` or below to `high` or above, counted for every (low, high) of a
    grid, beside the rows where `truth` holds.

    All parameter sets share one shuffle and sort of the rows, which are not multiplied: each set is a column of the same
    window, and a key's counts become rows only after they are summed. A series starts up; missing values change nothing.
    """
    w = Window.partitionBy(key).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    down = lambda low, high: F.when(F.col(value) <= low, True).when(F.col(value) >= high, False)
    phases = {f"_down{k}": F.coalesce(F.last(down(*pair), ignorenulls=True).over(upto), F.lit(False)) for k, pair in enumerate(grid)}
    phased = df.select(key, *order, truth.alias("_truth"), F.col(value)).withColumns(phases)
    backs = phased.withColumns({f"_back{k}": ~F.col(f"_down{k}") & F.lag(f"_down{k}", 1, False).over(w) for k in range(len(grid))})
    counts = backs.groupBy(key).agg(F.count_if("_truth").alias("_true"), *[F.count_if(f"_back{k}").alias(f"_n{k}") for k in range(len(grid))])
    each = counts.select(key, "_true", F.posexplode(F.array(*[f"_n{k}" for k in range(len(grid))])).alias("params", "counted"))
    return each.select("params", key, "counted", F.abs(F.col("counted") - F.col("_true")).alias("abs_error"))


def rank_parameters(scored: DataFrame) -> DataFrame:
    """Parameters by mean absolute error, then by share of near hits."""
    return scored.groupBy("params").agg(F.avg("abs_error").alias("mae"), F.avg(F.col("off_by_one").cast("double")).alias("obo")).orderBy("mae", F.desc("obo"), "params")


def pick_traces(scored: DataFrame, n: int) -> DataFrame:
    """The success with the most marks first, then the worst misses; n rows in all."""
    best = scored.where("abs_error = 0").orderBy(F.desc("truth"), "video_id").limit(1)
    worst = scored.where("abs_error > 0").orderBy(F.desc("abs_error"), "video_id").limit(n)
    return best.withColumn("_r", F.lit(0)).unionByName(worst.withColumn("_r", F.lit(1))).orderBy("_r", F.desc("abs_error"), "video_id").limit(n).drop("_r")


def bucket_rollup(df: DataFrame, text: str, size: str, rules: list[tuple[str, str]], other: str, by: list[str] | None = None) -> DataFrame:
    """(bucket, by, n, size): rows and their total size by the first (name, pattern) rule that a text matches."""
    bucket = F.lit(other)
    for name, pattern in reversed(rules):
        bucket = F.when(F.col(text).rlike(pattern), name).otherwise(bucket)
    return df.groupBy(bucket.alias("bucket"), *(by or [])).agg(F.count("*").alias("n"), F.sum(size).alias("size"))


def main_axes(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, variance, axis): the direction of the largest population variance of each key's vectors of one length, its
    largest component positive. A task gives one row of sums and products per key; null vectors take no part."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for frame in frames:
            for name, part in frame.dropna(subset=[vector]).groupby(key, dropna=False)[vector]:
                x = np.stack(part.to_list())
                n, s, p = total.get(name, (0, 0.0, 0.0))
                total[name] = n + len(x), s + x.sum(0), p + x.T @ x
        if total:
            yield pd.DataFrame([(k, n, s.tolist(), p.ravel().tolist()) for k, (n, s, p) in total.items()], columns=[key, "n", "s", "p"])

    def axis(frame: pd.DataFrame) -> pd.DataFrame:
        n, s, p = frame["n"].sum(), np.sum(frame["s"].to_list(), 0), np.sum(frame["p"].to_list(), 0)
        w, v = np.linalg.eigh(p.reshape(len(s), len(s)) / n - np.outer(s / n, s / n))
        a = v[:, -1] * (1 if v[np.abs(v[:, -1]).argmax(), -1] > 0 else -1)
        return pd.DataFrame({key: [frame[key].iloc[0]], "variance": [float(w[-1])], "axis": [a.tolist()]})

    kind = df.schema[key].dataType.simpleString()
    partial = df.select(key, vector).mapInPandas(sums, f"{key} {kind}, n long, s array<double>, p array<double>")
    return partial.groupBy(key).applyInPandas(axis, f"{key} {kind}, variance double, axis array<double>")
