"""Queries that train models on the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.operators import boosting
from cadence.plans.registry import query, table


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL), c AS (SELECT label, count(*) AS n FROM v GROUP BY label), t AS (SELECT count(*) AS k, sum(n) AS total FROM c),
x AS (SELECT vec_id, label, unnest(range(64)) AS feature, unnest(list_transform(e, lambda y: floor(y * 8))) AS x FROM v),
r AS (SELECT x.feature, x.x, k.label AS y, CAST(total AS DOUBLE) / (k * c.n) AS w, CAST(1 AS DOUBLE) / k AS p, CASE WHEN x.label = k.label THEN 1 ELSE 0 END AS own FROM x JOIN c ON c.label = x.label CROSS JOIN t CROSS JOIN (SELECT label FROM c) k),
s AS (SELECT y, feature, x, sum(w * (p - own)) AS g, sum(w * p * (1 - p)) AS h, count(*) AS n FROM r GROUP BY y, feature, x),
l AS (SELECT y, feature, x, sum(g) OVER u AS gl, sum(h) OVER u AS hl, sum(n) OVER u AS nl, sum(g) OVER a AS g, sum(h) OVER a AS h, sum(n) OVER a AS n, lead(x) OVER (PARTITION BY y, feature ORDER BY x) AS above FROM s WINDOW u AS (PARTITION BY y, feature ORDER BY x), a AS (PARTITION BY y, feature)),
q AS (SELECT y, feature, (x + above) / 2 AS threshold, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) AS gain, gl, hl, g, h FROM l WHERE above IS NOT NULL AND nl >= 20 AND n - nl >= 20),
b AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY round(gain, 9) DESC, feature, threshold) AS place FROM q WHERE gain > 0)
SELECT y AS label, CAST(feature AS INT) AS feature, threshold, round(-0.1 * gl / (hl + 1), 7) AS below, round(-0.1 * (g - gl) / (h - hl + 1), 7) AS above FROM b WHERE place = 1""")
def boosted_stumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first round of boosted trees of two leaves on whole vectors, in eighths: each label's best split and its values."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: F.floor(v.cast("double") * 8).cast("double")).alias("x"))
    model = boosting.train(e, "x", "label", "vec_id", boosting.Boosting(rounds=1, leaves=2, held_out=0.0))
    rows = [(v, *((f := t.splits[1])[0], f[2], round(t.values[2], 7), round(t.values[3], 7))) for v, t in zip(model.labels, model.rounds[0], strict=True) if t.splits]
    return spark.createDataFrame(rows, "label int, feature int, threshold double, below double, above double")


@query()
def boosted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all vectors as boosted trees on them say."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    model = boosting.train(e, "embedding", "label", "vec_id", boosting.Boosting(rounds=3, leaves=8))
    return boosting.predict(e, "embedding", model).select("vec_id", "label", "predicted", F.round(F.array_max("probabilities"), 6).alias("probability"))
