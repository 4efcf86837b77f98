"""Queries over poses. The tables hold none, so poses are read off the numbers of `embeddings`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.functions import geometry as G
from cadence.functions.scalars import ratio
from cadence.kernels.counters import PoseCounter
from cadence.kernels.windows import WindowStream
from cadence.operators import forms, metrics
from cadence.operators.replay import replay
from cadence.plans.registry import query, r6, table


def pose_of(e: Column) -> Column:
    """Landmark i at components 2i and 2i + 1 (wrapping), around the middle of the frame; all in sight."""
    at = lambda i: F.lit(0.5) + F.get(e, F.lit(i % 64)).cast("double") / 2
    return F.array(*[F.struct(at(2 * i).alias("x"), at(2 * i + 1).alias("y"), F.lit(0.0).alias("z"), F.lit(0.9).cast("double").alias("visibility")) for i in range(33)])


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").alias("group"), pose_of(F.col("embedding")).alias("pose"), F.lit(1000).alias("width"), F.lit(1000).alias("height"))


def _xy(i: int) -> str:
    return f"0.5 + e[{2 * i % 64 + 1}] / 2, 0.5 + e[{(2 * i + 1) % 64 + 1}] / 2"


_POINTS = "p AS (SELECT vec_id, label, e, " + ", ".join(f"1000 * (0.5 + e[{2 * i % 64 + 1}] / 2) AS {n}x, 1000 * (0.5 + e[{(2 * i + 1) % 64 + 1}] / 2) AS {n}y" for n, i in (("s", 11), ("el", 13), ("w", 15), ("h", 23), ("a", 27), ("s2", 12), ("h2", 24))) + " FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"


@query(f"""WITH {_POINTS},
l AS (SELECT vec_id, 'lateral-raise-too-high' AS rule_id, (sy - wy) / nullif(sqrt((sx - hx) ** 2 + (sy - hy) ** 2), 0) AS value, NULL AS low, 0.15 AS high FROM p WHERE vec_id % 3 = 0
  UNION ALL SELECT vec_id, 'squat-torso-lean', degrees(atan2(abs(sx - hx), abs(sy - hy))), NULL, 45 FROM p WHERE vec_id % 3 = 1
  UNION ALL SELECT vec_id, r, CASE WHEN abs(ax - sx) >= 1e-9 THEN (hy - (sy + (ay - sy) * (hx - sx) / (ax - sx))) / sqrt((ax - sx) ** 2 + (ay - sy) ** 2) END, lo, hi FROM p, (VALUES ('plank-hips-low', NULL, 0.1), ('plank-hips-high', -0.12, NULL)) x(r, lo, hi) WHERE vec_id % 3 = 2)
SELECT vec_id, rule_id, 'left' AS side, round(value, 5) AS value, coalesce(value > high, false) OR coalesce(value < low, false) AS broken FROM l""")
def form_rule_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id") % 3
    f = frames(spark, sf_dir).withColumn("label", F.when(k == 0, "lateral_raise").when(k == 1, "squat").otherwise("plank"))
    return forms.evaluate_rules(f).select("vec_id", "rule_id", "side", F.round("value", 5).alias("value"), "broken")


@query(f"""WITH {_POINTS}, v AS (SELECT vec_id, CASE WHEN abs(ax - sx) >= 1e-9 THEN (hy - (sy + (ay - sy) * (hx - sx) / (ax - sx))) / sqrt((ax - sx) ** 2 + (ay - sy) ** 2) END AS o FROM p)
SELECT vec_id, CASE WHEN o > 0.1 THEN 'plank-hips-low' WHEN o < -0.12 THEN 'plank-hips-high' ELSE '' END AS broken, o BETWEEN -0.12 AND 0.1 AS in_position FROM v""")
def form_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = forms.evaluate_rules(frames(spark, sf_dir).withColumn("label", F.lit("plank")))
    return forms.frame_verdicts(e, ["vec_id"]).select("vec_id", F.array_join("broken", ",").alias("broken"), "in_position")


@query(f"""WITH {_POINTS}, q AS (SELECT vec_id, sqrt((sx - hx) ** 2 + (sy - hy) ** 2) AS torso, abs(sx - s2x) AS wide FROM p) SELECT vec_id, CASE WHEN torso > 0 AND wide / torso > 0.55 THEN 'frontal' END AS quality FROM q""")
def pose_quality_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.pose_quality(frames(spark, sf_dir), view="side").select("vec_id", "quality")


_NORMAL = "c AS (SELECT vec_id, label, (hx + h2x) / 2000 AS cx, (hy + h2y) / 2000 AS cy, (sqrt((sx - hx) ** 2 + (sy - hy) ** 2) + sqrt((s2x - h2x) ** 2 + (s2y - h2y) ** 2)) / 2000 AS scale, e, sx, sy, elx, ely, wx, wy FROM p)"


@query(f"""WITH {_POINTS}, {_NORMAL}, u AS (SELECT *, (sx - elx) AS ux, (sy - ely) AS uy, (wx - elx) AS vx, (wy - ely) AS vy FROM c)
SELECT vec_id, 47 AS width, round((e[1] / 2 + 0.5 - cx) / scale, 5) AS nose_x, round((e[2] / 2 + 0.5 - cy) / scale, 5) AS nose_y, round(degrees(acos(greatest(-1, least(1, (ux * vx + uy * vy) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy)))))) / 180, 5) AS left_elbow FROM u""")
def pose_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 47 features of a pose: the nose's place and the left elbow's angle of them."""
    f = frames(spark, sf_dir).withColumn("f", G.frame_features(G.normalize_points(G.select_landmarks(F.col("pose"), F.col("width"), F.col("height")))))
    at = lambda i: F.round(F.get("f", F.lit(i)), 5)
    return f.select("vec_id", F.size("f").alias("width"), at(0).alias("nose_x"), at(1).alias("nose_y"), at(39).alias("left_elbow"))


@query(f"""WITH {_POINTS}, {_NORMAL} SELECT vec_id, round(-(e[1] / 2 + 0.5 - cx) / scale, 5) AS nose_x, round(-(s2x / 1000 - cx) / scale, 5) AS left_shoulder_x FROM c JOIN (SELECT vec_id, s2x FROM p) USING (vec_id)""")
def mirrored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("f", G.mirror(G.frame_features(G.normalize_points(G.select_landmarks(F.col("pose"), F.col("width"), F.col("height"))))))
    return f.select("vec_id", F.round(F.get("f", F.lit(0)), 5).alias("nose_x"), F.round(F.get("f", F.lit(3)), 5).alias("left_shoulder_x"))


@query("""WITH v AS (SELECT vec_id, label, CASE WHEN embedding[1] > 0 THEN abs(embedding[2]) END AS vis, embedding[3] > 0 AS d FROM embeddings), n AS (SELECT label, count(*) AS frames, count(*) FILTER (vis IS NOT NULL) AS detected, round(avg(CAST(vis AS DOUBLE)), 6) AS visibility FROM v GROUP BY label)
SELECT label, frames, detected, visibility, round(100.0 * detected / frames, 6) AS detected_pct FROM n ORDER BY detected_pct, label""")
def pose_quality_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadence.operators import quality

    seen = F.get("embedding", F.lit(0)) > 0
    vis = F.when(seen, F.abs(F.get("embedding", F.lit(1))).cast("double"))
    videos = table(spark, sf_dir, "embeddings").select("label", F.lit(0.0).alias("duration_s"), F.lit(1).alias("n_frames"), seen.cast("int").alias("n_detected"), *[vis.alias(f"vis_{g}") for g in quality.GROUPS], F.lit("unknown").alias("side"))
    c = quality.by_class(videos)
    return c.select("label", F.col("n_frames").alias("frames"), F.col("n_detected").alias("detected"), r6("vis_hip").alias("visibility"), r6("detected_pct").alias("detected_pct"))


def _sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's vectors as one recording at 10 frames a second."""
    k = F.row_number().over(Window.partitionBy("group").orderBy("vec_id")) - 1
    return frames(spark, sf_dir).withColumn("ts_ms", F.floor(k * 100 + 0.5).cast("double"))


@query()
def pose_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replay(_sequence(spark, sf_dir), ["group"], ["ts_ms", "vec_id"], PoseCounter())
    return out.groupBy("group").agg(F.count("*").alias("ticks"), F.max("count").alias("count"), F.count_if("moving").alias("moving"))


def _ticks(seen: str = "true") -> str:
    """The recordings at 15 ticks a second as common table expressions: `i` has the nose (x, y) and the left elbow (a) of
    tick j, short gaps filled; frames for which `seen` doesn't hold have no pose."""
    fill = lambda c: f"coalesce(g.{c}, CASE WHEN bi - ai <= 6 THEN (q.{c} - p.{c}) / (bi - ai) * (g.j - ai) + p.{c} END) AS {c}"
    return f"""{_POINTS}, {_NORMAL}, u AS (SELECT *, (sx - elx) AS ux, (sy - ely) AS uy, (wx - elx) AS vx, (wy - ely) AS vy FROM c),
s AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, {seen} AS seen, (e[1] / 2 + 0.5 - cx) / scale AS x, (e[2] / 2 + 0.5 - cy) / scale AS y,
  degrees(acos(greatest(-1, least(1, (ux * vx + uy * vy) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy)))))) / 180 AS a FROM u),
t AS (SELECT label, j FROM (SELECT label, count(*) AS n, unnest(range(0, 2 * count(*))) AS j FROM s GROUP BY label) WHERE j * (CAST(1000 AS DOUBLE) / 15) <= (n - 1) * 100),
m AS (SELECT t.label, t.j, CASE WHEN seen THEN x END AS x, CASE WHEN seen THEN y END AS y, CASE WHEN seen THEN a END AS a FROM t JOIN s ON s.label = t.label AND s.k = round(t.j * 2 / 3.0)),
g AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN j END) OVER (PARTITION BY label ORDER BY j ROWS UNBOUNDED PRECEDING) AS ai, min(CASE WHEN x IS NOT NULL THEN j END) OVER (PARTITION BY label ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bi FROM m),
i AS (SELECT g.label, g.j, {fill("x")}, {fill("y")}, {fill("a")} FROM g LEFT JOIN m p ON p.label = g.label AND p.j = g.ai LEFT JOIN m q ON q.label = g.label AND q.j = g.bi)"""


#: Full windows of 30 ticks, 15 apart, with 0 for what is missing.
_CUT = """r AS (SELECT label, j, list(coalesce(x, 0)) OVER w AS xs, list(coalesce(a, 0)) OVER w AS s, avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0 END) OVER w AS missing FROM i WINDOW w AS (PARTITION BY label ORDER BY j ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)),
w AS (SELECT * FROM r WHERE len(xs) = 30 AND j % 15 = 0)"""


@query(f"""WITH {_ticks()}, {_CUT}
SELECT label AS "group", CAST(j AS INT) AS start, CAST(missing AS DOUBLE) AS missing_ratio, missing <= 0.3 AS usable, 30 AS length, round(xs[1], 5) AS first, round(xs[30], 5) AS last FROM w""")
def pose_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replay(_sequence(spark, sf_dir), ["group"], ["ts_ms", "vec_id"], WindowStream())
    at = lambda k: F.round(F.get(F.get("rows", F.lit(k)), F.lit(0)), 5)
    return out.select("group", "start", "missing_ratio", "usable", F.size("rows").alias("length"), at(0).alias("first"), at(29).alias("last"))


@query()
def pca_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main axis of each label's vectors from one pass: a task adds up its sums and products per label and gives one
    matrix each, and the axis is found per label on their total."""
    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("e"))
    return metrics.main_axes(e, "label", "e").select("label", r6("variance").alias("variance"), F.transform("axis", lambda x: F.round(x, 6)).alias("axis"))


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recordings as a table of frames; every seventh frame has no pose."""
    s = _sequence(spark, sf_dir)
    k = F.row_number().over(Window.partitionBy("group").orderBy("vec_id")) - 1
    seen = F.when(F.col("vec_id") % 7 != 0, F.col("pose"))
    return s.select(F.concat(F.lit("v"), "group").alias("video_id"), F.when(F.col("group") % 2 == 0, "squat").otherwise("curl").alias("label"), k.alias("frame_idx"), "ts_ms", seen.alias("pose"), "width", "height")


@query("""WITH f AS (SELECT 'v' || label AS video_id, CASE WHEN label % 2 = 0 THEN 'squat' ELSE 'curl' END AS cls, vec_id % 7 <> 0 AS seen FROM embeddings), v AS (SELECT video_id, cls, count(*) AS n_frames, count(*) FILTER (seen) AS n_detected FROM f GROUP BY ALL)
SELECT cls AS label, count(*) AS n_videos, CAST(sum(n_frames) AS BIGINT) AS n_frames, CAST(sum(n_detected) AS BIGINT) AS n_detected, 0.9 AS vis_hip, round(100.0 * sum(n_detected) / sum(n_frames), 6) AS detected_pct, 'balanced' AS side FROM v GROUP BY cls""")
def quality_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadence.operators import quality

    c = quality.by_class(quality.video_quality(_videos(spark, sf_dir)))
    return c.select("label", "n_videos", "n_frames", "n_detected", r6("vis_hip").alias("vis_hip"), r6("detected_pct").alias("detected_pct"), "side")


@query("""WITH f AS (SELECT 'v' || label AS video_id, CASE WHEN label % 2 = 0 THEN 'squat' ELSE 'curl' END AS cls, vec_id % 7 <> 0 AS seen FROM embeddings), v AS (SELECT video_id, cls, count(*) AS n, count(*) FILTER (seen) AS d FROM f GROUP BY ALL), c AS (SELECT cls, 100.0 * sum(d) / sum(n) AS pct FROM v GROUP BY cls)
SELECT finding, round(CAST(value AS DOUBLE), 6) AS value, detail FROM (SELECT 'detected_pct' AS finding, (SELECT 100.0 * sum(d) / sum(n) FROM v) AS value, NULL AS detail
UNION ALL SELECT 'worst_class', * FROM (SELECT pct, cls FROM c ORDER BY pct, cls LIMIT 1) UNION ALL SELECT 'best_class', * FROM (SELECT pct, cls FROM c ORDER BY pct DESC, cls LIMIT 1)
UNION ALL SELECT 'low_classes', count(*), coalesce(string_agg(cls, ', ' ORDER BY cls), '') FROM c WHERE pct < 80 UNION ALL SELECT 'weak_videos', count(*), coalesce(string_agg(video_id, ', ' ORDER BY video_id), '') FROM v WHERE d < 0.5 * n
UNION ALL SELECT 'weakest_joint', 0.9, 'ankle' UNION ALL SELECT 'weakest_classes', count(*), string_agg(cls, ', ' ORDER BY cls) FROM c UNION ALL SELECT 'side_share', 1.0, 'balanced' UNION ALL SELECT 'without_pose', count(*), coalesce(string_agg(video_id, ', ' ORDER BY video_id), '') FROM v WHERE d = 0)""")
def quality_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadence.operators import quality

    v = quality.video_quality(_videos(spark, sf_dir))
    return quality.findings(quality.by_class(v), v).withColumn("value", r6("value"))


@query(f"""WITH {_ticks("vec_id % 7 <> 0")}
SELECT 'v' || label AS video_id, CAST(j AS INT) AS k, x IS NULL AS missing, round(x, 5) AS nose_x, round(y, 5) AS nose_y, round(a, 5) AS left_elbow FROM i""")
def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature rows of every tick: the nose's place and the left elbow's angle of them."""
    from cadence.operators import features

    at = lambda i: F.round(F.get("features", F.lit(i)), 5)
    return features.sequence_features(_videos(spark, sf_dir)).select("video_id", "k", "missing", at(0).alias("nose_x"), at(1).alias("nose_y"), at(39).alias("left_elbow"))


@query(f"""WITH {_ticks("vec_id % 7 <> 0")}, {_CUT}, y AS (SELECT *, row_number() OVER (ORDER BY label, j) AS n FROM w WHERE missing <= 0.3),
v AS (SELECT n, unnest(s) - list_avg(s) AS v, generate_subscripts(s, 1) - 1 AS k FROM y), f AS (SELECT n, line, sum(v * cos(2 * pi() * line * k / 30)) ** 2 + sum(v * sin(2 * pi() * line * k / 30)) ** 2 AS power FROM v, range(1, 16) l(line) GROUP BY ALL),
d AS (SELECT n, arg_max(line, power) / 2 AS frequency FROM f GROUP BY n)
SELECT 'v' || label AS video_id, CAST(j AS INT) AS start, 243 AS features, round(list_avg(xs), 5) AS mean, round(list_stddev_pop(xs), 5) AS deviation, round(list_max(xs) - list_min(xs), 5) AS span, frequency FROM y JOIN d USING (n)""")
def window_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """243 summary features per usable window, as a model's input: the nose's and the left elbow's of them."""
    from cadence.operators import features, models

    w = features.feature_windows(_videos(spark, sf_dir)).where("usable").select("video_id", "start", "rows")
    at = lambda name: F.get("summary", F.lit(models.feature_names().index(name)))
    r5 = lambda name: F.round(at(name), 5)
    return models.summary_features(w).select("video_id", "start", F.size("summary").alias("features"), r5("mean_p0_x").alias("mean"), r5("std_p0_x").alias("deviation"), r5("range_p0_x").alias("span"), at("frequency_angle0").alias("frequency"))


@query()
def counter_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score the pose counter on the recordings, with a mark every two seconds as the truth."""
    from cadence.operators import evaluate

    frames_of = _videos(spark, sf_dir)
    marks = frames_of.where(F.col("frame_idx") % 20 == 10).groupBy("video_id", "label").agg(F.array_sort(F.collect_list(F.col("ts_ms").cast("long"))).alias("m"))
    sheet = marks.select("video_id", "label", F.size("m").cast("string").alias("rep_count"), F.array_join(F.transform("m", lambda t: t.cast("string")), ";").alias("rep_timestamps_ms"), F.lit("false").alias("is_ambiguous"))
    return evaluate.score(frames_of, sheet, "generic")
