"""Queries of kernels, documents and forms whose inputs are made from `embeddings` and `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions import geometry as G
from cadence.kernels.counters import PeakCounter
from cadence.kernels.forms import CATALOG
from cadence.kernels.states import ScoreSmoother
from cadence.kernels.workout import Workout
from cadence.operators import features, forms
from cadence.operators.replay import replay
from cadence.plans.poses import _POINTS, _sequence, frames
from cadence.plans.registry import EVENTS, events, query, r6, table
from cadence.sources import sinks, tables

_LABELS = [f"c{k:02d}" for k in range(64)]


@query("""WITH RECURSIVE v AS (SELECT vec_id, label AS grp, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings), x AS (SELECT vec_id, grp, k, list_transform(e, lambda y: exp(y - list_max(e))) AS x FROM v),
p AS (SELECT vec_id, grp, k, list_transform(x, lambda y: y / list_sum(x)) AS p FROM x),
r AS (SELECT grp, k, vec_id, p AS now FROM p WHERE k = 1 UNION ALL SELECT p.grp, p.k, p.vec_id, list_transform(list_zip(p.p, r.now), lambda z: 0.4 * z[1] + 0.6 * z[2]) FROM r JOIN p ON p.grp = r.grp AND p.k = r.k + 1),
u AS (SELECT grp, vec_id, unnest(now) AS q, generate_subscripts(now, 1) - 1 AS i FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY q DESC, i) AS n FROM u), j AS (SELECT a.grp, a.vec_id, a.i, a.q, a.q - b.q AS margin FROM o a JOIN o b ON a.vec_id = b.vec_id AND a.n = 1 AND b.n = 2)
SELECT grp, vec_id, printf('c%02d', i) AS label, round(q, 6) AS confidence, round(margin, 6) AS margin, CASE WHEN vec_id % 7 = 0 THEN 'poor-pose' WHEN q < 0.0195 THEN 'low-confidence' WHEN margin < 0.0005 THEN 'close-call' END AS reason FROM j""")
def smoothed_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole vectors as scores of 64 classes, smoothed from window to window and judged."""
    v = table(spark, sf_dir, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").cast("double").alias("ts_ms"), F.transform("embedding", lambda x: x.cast("double")).alias("scores"), (F.col("vec_id") % 7 == 0).alias("poor_pose"))
    out = replay(v, ["grp"], ["ts_ms"], ScoreSmoother(_LABELS, 0.4, 0.0195, 0.0005))
    return out.select("grp", F.col("ts_ms").cast("long").alias("vec_id"), "label", r6("confidence").alias("confidence"), r6("margin").alias("margin"), "reason")


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(unnest(range(33)) AS INT) AS place FROM embeddings)
SELECT vec_id, place, round(0.5 + e[2 * place % 64 + 1] / 2, 5) AS x, CASE WHEN (vec_id + place) % 11 <> 0 THEN round(0.5 + e[(2 * place + 1) % 64 + 1] / 2, 5) END AS y, CAST(0.9 AS DOUBLE) AS visibility FROM v WHERE vec_id % 10 <> 3""")
def frame_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses as JSON frames, missing numbers as null in place and no pose as null, and read again."""
    holed = F.transform("pose", lambda p, i: F.struct(p["x"].alias("x"), F.when((F.col("vec_id") + i) % 11 == 0, F.lit(float("nan"))).otherwise(p["y"]).alias("y"), p["z"].alias("z"), p["visibility"].alias("visibility")))
    f = frames(spark, sf_dir).withColumn("pose", F.when(F.col("vec_id") % 10 != 3, holed))
    back = f.select("vec_id", tables.landmarks_from_json(sinks.frame_json(tables.clean_pose(F.col("pose")))).alias("p"))
    return back.select("vec_id", F.posexplode("p").alias("place", "q")).select("vec_id", "place", "q.x", "q.y", "q.visibility")


@query("SELECT vec_id, CASE WHEN vec_id % 10 = 3 THEN 0 ELSE len(list_filter(range(33), lambda i: (vec_id + i) % 4 <> 0)) END AS seen FROM embeddings")
def visible_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    faint = F.transform("pose", lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), F.when((F.col("vec_id") + i) % 4 == 0, 0.3).otherwise(p["visibility"]).alias("visibility")))
    f = frames(spark, sf_dir).withColumn("pose", F.when(F.col("vec_id") % 10 != 3, faint))
    return f.select("vec_id", G.visible_count(F.col("pose")).alias("seen"))


_NAMES = ", ".join("('{}', '{}')".format(c[0], str(c[1]).replace("'", "''")) for c in CATALOG)


@query(f"""WITH c AS (SELECT * FROM (VALUES {_NAMES}) x(label, name)), d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE (SELECT list(label ORDER BY label) FROM c)[doc_id % (SELECT count(*) FROM c) + 1] END AS label FROM documents)
SELECT doc_id, label, coalesce(name, label) AS name FROM d LEFT JOIN c USING (label)""")
def catalog_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.array(*[F.lit(v) for v in sorted(c[0] for c in CATALOG)])
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.get(known, (F.col("doc_id") % len(CATALOG)).cast("int"))).alias("label"))
    return forms.with_names(d).select("doc_id", "label", "name")


@query(f"""WITH {_POINTS}, u AS (SELECT vec_id, (sx - elx) AS ux, (sy - ely) AS uy, (wx - elx) AS vx, (wy - ely) AS vy, degrees(atan2(abs(sx - hx), abs(sy - hy))) AS lean FROM p)
SELECT vec_id, round(degrees(acos(greatest(-1, least(1, (ux * vx + uy * vy) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy)))))), 4) AS angle, CASE WHEN lean > 45 THEN 'torso-lean' ELSE '' END AS warnings FROM u""")
def exercise_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = forms.measure_exercise(frames(spark, sf_dir), ["shoulder", "elbow", "wrist"], lean=45.0)
    return m.select("vec_id", F.round("angle", 4).alias("angle"), F.array_join("warnings", ",").alias("warnings"))


@query(f"""WITH {EVENTS}, k AS (SELECT user_id FROM e GROUP BY user_id HAVING count(*) > 60), s AS (SELECT user_id, t, round(value, 2) AS v FROM e JOIN k USING (user_id))
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t, v) - 1 AS INT) AS place, t, v FROM s""")
def signal_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of the busiest series as documents, and read again."""
    e = events(spark, sf_dir)
    docs = sinks.trace_json(e, e.groupBy("user_id").count().where("count > 60"), "user_id", "t", "value", 2)
    back = docs.select("user_id", F.from_json("json", "t array<bigint>, v array<double>").alias("d"))
    return back.select("user_id", F.posexplode(F.arrays_zip("d.t", "d.v")).alias("place", "x")).select("user_id", "place", "x.t", "x.v")


@query("""WITH s AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) SELECT '{"labels":[' || string_agg('"' || source || '"', ',' ORDER BY source) || '],"thresholds":{"confidence":0.65,"margin":0.45},"window":{"length":30,"stride":15}}' AS json FROM s""")
def labels_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = features.vocabulary(table(spark, sf_dir, "documents").select(F.col("source").alias("label")))
    return sinks.labels_document(vocabulary, 0.65, 0.45, 30, 15)


@query()
def peak_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain yardstick over the poses in sequence."""
    return replay(_sequence(spark, sf_dir), ["group"], ["ts_ms"], PeakCounter())


@query()
def workout_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: each series is started and told its exercise, then its poses follow, then it is stopped."""
    seq = _sequence(spark, sf_dir)
    none = {"label": "string", "enabled": "boolean", "scores": "array<double>", "poor_pose": "boolean"}
    posed = seq.select("group", F.col("ts_ms").cast("double").alias("ts_ms"), F.lit(None).cast("string").alias("kind"), *[F.lit(None).cast(t).alias(n) for n, t in none.items()], "pose", "width", "height")
    edge = lambda at, kind, label: seq.groupBy("group").agg(at.cast("double").alias("ts_ms")).select("group", "ts_ms", F.lit(kind).alias("kind"), F.lit(label).cast("string").alias("label"))
    controls = edge(F.min("ts_ms") - 2, "start", None).unionByName(edge(F.min("ts_ms") - 1, "choose", "squat")).unionByName(edge(F.max("ts_ms") + 1, "stop", None))
    rows = posed.unionByName(controls, allowMissingColumns=True)
    return replay(rows, ["group"], ["ts_ms"], Workout()).select("group", "ts_ms", "kind", "label", "number", "text", "duration_ms", "missing_ratio")
