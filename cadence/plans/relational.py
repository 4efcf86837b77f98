"""Queries of the relational operators over the other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.functions import scalars as S
from cadence.operators import dedup, metrics, split
from cadence.operators import labels as sheets
from cadence.plans.registry import EVENTS, events, query, r6, table
from cadence.sources import sinks
from cadence.sources.tables import detection_rollup


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"), "label")


_EMB = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"


@query(f"""WITH {_EMB}, s AS (SELECT vec_id, list_transform(e[1:10], lambda x: exp(x - list_max(e[1:10]))) AS x FROM v),
p AS (SELECT vec_id, list_transform(x, lambda y: y / list_sum(x)) AS p FROM s), u AS (SELECT vec_id, unnest(p) AS q, generate_subscripts(p, 1) - 1 AS i FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY q DESC, i) AS r FROM u),
t AS (SELECT a.vec_id, 'c' || a.i AS label, a.q AS confidence, a.q - b.q AS margin FROM o a JOIN o b ON a.vec_id = b.vec_id AND a.r = 1 AND b.r = 2)
SELECT vec_id, label, round(confidence, 6) AS confidence, round(margin, 6) AS margin, CASE WHEN vec_id % 7 = 0 THEN 'poor-pose' WHEN confidence < 0.13 THEN 'low-confidence' WHEN margin < 0.01 THEN 'close-call' END AS reason FROM t""")
def softmax_top2_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array(*[F.lit(f"c{k}") for k in range(10)])
    v = S.verdict(S.softmax(F.slice("e", 1, 10)), labels, F.col("vec_id") % 7 == 0, 0.13, 0.01)
    out = _embeddings(spark, sf_dir).select("vec_id", v.alias("v"))
    return out.select("vec_id", "v.label", r6("v.confidence").alias("confidence"), r6("v.margin").alias("margin"), "v.reason")


@query(f"""WITH {_EMB} SELECT a.vec_id, round(degrees(acos(greatest(-1, least(1, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)))))), 4) AS angle FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def embedding_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _embeddings(spark, sf_dir)
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    cosine = S.dot(F.col("e"), F.col("f")) / F.sqrt(S.dot(F.col("e"), F.col("e")) * S.dot(F.col("f"), F.col("f")))
    return v.join(nxt, "vec_id").select("vec_id", F.round(S.arccos_degrees(cosine), 4).alias("angle"))


@query(f"WITH {_EMB}, u AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v) SELECT label, CAST(i - 1 AS INT) AS place, round(avg(x), 6) AS mean FROM u GROUP BY label, i")
def vector_mean_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.mean_vectors(_embeddings(spark, sf_dir), "label", "e")
    return m.select("label", F.posexplode("mean").alias("place", "m")).select("label", "place", r6("m").alias("mean"))


#: Bits of a document's similarity hash: the signs of sums over its words' hashes.
BITS = 60
HALF = BITS // 2


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    each = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(words).alias("w")).select("id", F.conv(F.substring(F.md5("w"), 1, BITS // 4), 16, 10).cast("bigint").alias("h"))
    # Two counts a sum, HALF bits apart: no text has 2 ** HALF words.
    pair = F.lit(1 | 1 << HALF).cast("bigint")
    sums = each.groupBy("id").agg(F.count("*").alias("n"), *[F.sum(F.shiftright("h", i).bitwiseAND(pair)).alias(f"s{i}") for i in range(HALF)])
    count = lambda i: F.col(f"s{i}").bitwiseAND(F.lit((1 << HALF) - 1)) if i < HALF else F.shiftright(f"s{i - HALF}", HALF)
    signs = [F.when(2 * count(i) > F.col("n"), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i in range(BITS)]
    total = signs[0]
    for v in signs[1:]:
        total = total + v
    return sums.select("id", F.array(total).alias("hashes"))


_HASH = f"""w AS (SELECT doc_id AS id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS w FROM documents), x AS (SELECT id, CAST('0x' || substr(md5(w), 1, {BITS // 4}) AS BIGINT) AS h FROM w),
c AS (SELECT id, i, count(*) AS n, sum((h >> i) & 1) AS s FROM x, range({BITS}) r(i) GROUP BY id, i), b AS (SELECT id, CAST(sum(CASE WHEN 2 * s > n THEN CAST(1 AS BIGINT) << i ELSE 0 END) AS BIGINT) AS h FROM c GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.h, b.h)) AS DOUBLE) AS distance FROM b a JOIN b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 6)"""


@query(f"WITH {_HASH}, k AS (SELECT h, min(id) AS r FROM b GROUP BY h), q AS (SELECT a, b, distance FROM p JOIN b x ON x.id = p.a JOIN b y ON y.id = p.b JOIN k i ON i.h = x.h AND i.r = p.a JOIN k j ON j.h = y.h AND j.r = p.b) SELECT a, b, distance FROM q")
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_pairs(_hashed(spark, sf_dir), 6)


@query(f"""WITH RECURSIVE {_HASH}, l AS (SELECT a AS x, b AS y FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT id AS x, id AS c FROM b UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.x),
m AS (SELECT x AS id, min(c) AS component FROM r GROUP BY x) SELECT id, component, printf('g%04d', dense_rank() OVER (ORDER BY component) - 1) AS group_id FROM m""")
def duplicate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_groups(_hashed(spark, sf_dir), 6)


@query(f"""WITH RECURSIVE {_HASH}, th AS (SELECT unnest([3, 6]) AS t), l AS (SELECT t, a AS x, b AS y FROM p, th WHERE distance <= t UNION ALL SELECT t, b, a FROM p, th WHERE distance <= t),
r AS (SELECT t, id AS x, id AS c FROM b, th UNION SELECT r.t, l.y, r.c FROM r JOIN l ON l.x = r.x AND l.t = r.t), m AS (SELECT t, x, min(c) AS c FROM r GROUP BY t, x), s AS (SELECT t, c, count(*) AS n FROM m GROUP BY t, c HAVING count(*) > 1)
SELECT CAST(th.t AS INT) AS threshold, count(s.n) AS groups, CAST(coalesce(sum(s.n), 0) AS BIGINT) AS grouped FROM th LEFT JOIN s ON s.t = th.t GROUP BY th.t""")
def duplicate_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.threshold_sensitivity(_hashed(spark, sf_dir), [3, 6])


@query("""WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r, CAST(sum(n) OVER (PARTITION BY source) AS BIGINT) AS size FROM n)
SELECT source AS group_id, lang AS label, size FROM r WHERE r = 1""")
def group_majority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.group_labels(table(spark, sf_dir, "documents").select(F.col("source").alias("group_id"), F.col("lang").alias("label")))


@query("""WITH n AS (SELECT lang AS label, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, round_even(n * 0.15, 0)) ELSE round_even(n * 0.15, 0) END AS v FROM n)
SELECT label, n, CAST(n - 2 * v AS INT) AS train, CAST(v AS INT) AS val, CAST(v AS INT) AS test FROM t""")
def stratified_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("label")).agg(F.count("*").alias("n"))
    return n.withColumn("t", split.split_targets(F.col("n"))).select("label", "n", "t.train", "t.val", "t.test")


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.concat(F.col("lang"), F.lit("-"), (F.col("doc_id") / 3).cast("long").cast("string"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("video_id"), F.col("lang").alias("label"), group.alias("group_id"))


@query("""WITH RECURSIVE v AS (SELECT CAST(doc_id AS VARCHAR) AS video_id, lang AS label, lang || '-' || (doc_id // 3) AS group_id FROM documents), g AS (SELECT label, group_id, count(*) AS n FROM v GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, md5('42:' || label || ':' || group_id), group_id) AS k FROM g),
t AS (SELECT label, CAST(sum(n) AS BIGINT) AS total, CAST(CASE WHEN sum(n) >= 3 THEN greatest(1, round_even(sum(n) * 0.15, 0)) ELSE round_even(sum(n) * 0.15, 0) END AS BIGINT) AS v FROM g GROUP BY label),
r AS (SELECT label, CAST(0 AS BIGINT) AS k, total - 2 * v AS a, v AS b, v AS c, '' AS split FROM t UNION ALL SELECT r.label, o.k, a - CASE WHEN a >= b AND a >= c THEN n ELSE 0 END, b - CASE WHEN b > a AND b >= c THEN n ELSE 0 END, c - CASE WHEN c > a AND c > b THEN n ELSE 0 END,
CASE WHEN a >= b AND a >= c THEN 'train' WHEN b >= c THEN 'val' ELSE 'test' END FROM r JOIN o ON o.label = r.label AND o.k = r.k + 1)
SELECT v.group_id, v.video_id, v.label, r.split FROM v JOIN o USING (group_id) JOIN r ON r.label = o.label AND r.k = o.k""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_split(_videos(spark, sf_dir))


@query("""WITH RECURSIVE v AS (SELECT lang AS label, doc_id // 3 AS grp FROM documents), g AS (SELECT label, grp, count(*) AS n FROM v GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, grp) AS k FROM g),
t AS (SELECT label, CAST(sum(n) AS BIGINT) AS total, CAST(CASE WHEN sum(n) >= 3 THEN greatest(1, round_even(sum(n) * 0.15, 0)) ELSE round_even(sum(n) * 0.15, 0) END AS BIGINT) AS v FROM g GROUP BY label),
r AS (SELECT label, CAST(0 AS BIGINT) AS k, total - 2 * v AS a, v AS b, v AS c FROM t UNION ALL SELECT r.label, o.k, a - CASE WHEN a >= b AND a >= c THEN n ELSE 0 END, b - CASE WHEN b > a AND b >= c THEN n ELSE 0 END, c - CASE WHEN c > a AND c > b THEN n ELSE 0 END FROM r JOIN o ON o.label = r.label AND o.k = r.k + 1),
f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k DESC) AS last FROM r)
SELECT label, total - 2 * v - a AS train, v - b AS val, v - c AS test, total FROM f JOIN t USING (label) WHERE last = 1""")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_counts(split.stratified_split(_videos(spark, sf_dir)))


@query("""SELECT o_orderpriority AS label, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p, count(*) AS total FROM orders GROUP BY 1""")
def pivot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("split"))
    return split.split_counts(o, ("F", "O", "P")).select("label", *[F.col(k).alias(k.lower()) for k in "FOP"], "total")


@query("""SELECT l_returnflag AS label, count(*) AS rows, round(sum(l_quantity), 2) AS weight, round(sum(l_discount * l_quantity) / nullif(sum(l_quantity), 0), 8) AS discount, round(sum(l_tax * l_quantity) / nullif(sum(l_quantity), 0), 8) AS tax FROM lineitem GROUP BY 1""")
def weighted_class_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("l_quantity")
    mean = lambda c: F.round(S.ratio(F.sum(F.col(c) * w), F.nullif(F.sum(w), F.lit(0.0))), 8)
    out = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("label")).agg(F.count("*").alias("rows"), F.round(F.sum(w), 2).alias("weight"), mean("l_discount").alias("discount"), mean("l_tax").alias("tax"))
    return out.orderBy("discount", "label")


@query("""WITH s AS (SELECT c_nationkey AS nation, CASE WHEN c_acctbal IS NULL THEN 'unknown' WHEN abs(c_acctbal - 4500) < 500 THEN 'balanced' WHEN c_acctbal > 4500 THEN 'left' ELSE 'right' END AS side FROM customer),
n AS (SELECT nation, side, count(*) AS n FROM s WHERE side <> 'unknown' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY n DESC, side) AS r, sum(n) OVER (PARTITION BY nation) AS total FROM n)
SELECT nation, side, round(n / total, 6) AS share FROM r WHERE r = 1""")
def dominant_side_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), S.dominant_side(F.col("c_acctbal"), F.lit(4500.0), 500).alias("side")).where("side <> 'unknown'")
    n = c.groupBy("nation", "side").agg(F.count("*").alias("n"))
    w = Window.partitionBy("nation")
    ranked = n.withColumns({"r": F.row_number().over(w.orderBy(F.desc("n"), "side")), "total": F.sum("n").over(w)})
    return ranked.where("r = 1").select("nation", "side", r6(F.col("n") / F.col("total")).alias("share"))


@query("""SELECT o_orderpriority AS label, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS n_ambiguous, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY 1""")
def class_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("n_ambiguous"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.min("o_totalprice").alias("min"), F.max("o_totalprice").alias("max"))


@query("""WITH n AS (SELECT quality AS "true", toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2) SELECT "true", predicted, n, round(n / sum(n) OVER (PARTITION BY "true"), 6) AS share FROM n""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(table(spark, sf_dir, "labels"), "quality", "toxic").withColumn("share", r6("share"))


@query("""WITH n AS (SELECT event_type AS "true", lag(event_type) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS predicted FROM events), c AS (SELECT "true", predicted, count(*) AS n FROM n WHERE predicted IS NOT NULL GROUP BY 1, 2), s AS (SELECT *, round(n / sum(n) OVER (PARTITION BY "true"), 6) AS share FROM c)
SELECT * FROM s WHERE "true" <> predicted ORDER BY n DESC, "true", predicted LIMIT 5""")
def worst_mistakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.col("event_type").alias("t"), F.lag("event_type").over(Window.partitionBy("user_id").orderBy("t", "event_id")).alias("p")).where("p is not null")
    return metrics.worst_mistakes(e, "t", "p", 5).withColumn("share", r6("share"))


@query("""WITH k AS (SELECT unnest([0, 1, 2]) AS label), c AS (SELECT label, (SELECT count(*) FROM labels WHERE quality = label AND toxic = label) AS tp, (SELECT count(*) FROM labels WHERE quality = label) AS s, (SELECT count(*) FROM labels WHERE toxic = label) AS p FROM k)
SELECT CAST(label AS INT) AS label, tp, p - tp AS fp, s - tp AS fn, s AS support, round(coalesce(tp / nullif(p, 0), 0), 6) AS precision, round(coalesce(tp / nullif(s, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(p + s, 0), 0), 6) AS f1 FROM c""")
def f1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.f1_report(table(spark, sf_dir, "labels"), "quality", "toxic", spark.createDataFrame([(0,), (1,), (2,)], "label int"))
    return out.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query("""WITH k AS (SELECT unnest([0, 1, 2]) AS label), c AS (SELECT label, (SELECT count(*) FROM labels WHERE quality = label AND toxic = label) AS tp, (SELECT count(*) FROM labels WHERE quality = label) AS s, (SELECT count(*) FROM labels WHERE toxic = label) AS p FROM k)
SELECT (SELECT count(*) FROM labels) AS n, (SELECT round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0 END), 6) FROM labels) AS accuracy, round(avg(coalesce(2 * tp / nullif(p + s, 0), 0)), 6) AS macro_f1 FROM c""")
def overall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.overall(table(spark, sf_dir, "labels"), "quality", "toxic", spark.createDataFrame([(0,), (1,), (2,)], "label int"))
    return out.select("n", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"))


@query("""WITH c AS (SELECT CAST(k AS DOUBLE) * CAST(0.05 AS DOUBLE) AS cut FROM range(20) x(k)), s AS (SELECT value / 100 AS score, value > 20 OR event_type = 'view' AS ok FROM events),
k AS (SELECT cut, count(*) AS kept, avg(CASE WHEN ok THEN 1.0 ELSE 0 END) AS accuracy FROM c JOIN s ON score >= cut GROUP BY cut)
SELECT round(cut, 2) AS cut, kept, round(kept / (SELECT count(*) FROM s), 6) AS coverage, round(accuracy, 6) AS accuracy, cut = coalesce(min(CASE WHEN accuracy >= 0.9 THEN cut END) OVER (), max(cut) OVER ()) AS chosen FROM k""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").select((F.col("value") / 100).alias("score"), ((F.col("value") > 20) | (F.col("event_type") == "view")).alias("ok"))
    out = metrics.sweep(s, "score", "ok", [k * 0.05 for k in range(20)], 0.9)
    return out.select(F.round("cut", 2).alias("cut"), "kept", r6("coverage").alias("coverage"), r6("accuracy").alias("accuracy"), "chosen")


@query("""WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), k AS (SELECT CAST(unnest(range(-1, 12)) AS INT) AS label)
SELECT k.label, coalesce(n.n, 0) AS n, round(coalesce((SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * n.n), 0), 6) AS weight FROM k LEFT JOIN n USING (label)""")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = spark.range(-1, 12).select(F.col("id").cast("int").alias("label"))
    return metrics.class_weights(table(spark, sf_dir, "embeddings").withColumnRenamed("label", "y"), "y", k).withColumn("weight", r6("weight"))


def _marks(spark: SparkSession, sf_dir: str, kind: str, name: str) -> DataFrame:
    return events(spark, sf_dir).where(F.col("event_type") == kind).select("user_id", F.col("t").alias(name))


@query(f"""WITH {EVENTS}, x AS (SELECT c.user_id, c.t AS p, q.t AS t FROM e c JOIN e q ON c.user_id = q.user_id AND c.event_type = 'click' AND q.event_type = 'purchase' AND abs(c.t - q.t) <= 86400000)
SELECT user_id, count(*) AS pairs, min(abs(p - t)) AS nearest_ms FROM x GROUP BY user_id""")
def interval_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = metrics.within(_marks(spark, sf_dir, "click", "p"), _marks(spark, sf_dir, "purchase", "t"), "user_id", "p", "t", 86_400_000)
    return x.groupBy("user_id").agg(F.count("*").alias("pairs"), F.min("distance").alias("nearest_ms"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _marks(spark, sf_dir, "click", "p").groupBy("user_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    t = _marks(spark, sf_dir, "purchase", "t").groupBy("user_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    both = p.join(t, "user_id").withColumn("m", sheets.greedy_matches(F.col("p"), F.col("t"), 86_400_000))
    counts = both.select("user_id", F.size("p").alias("predicted"), F.size("t").alias("truth"), F.size("m").alias("matched"))
    return metrics.count_metrics(counts)


@query(f"""WITH RECURSIVE {EVENTS}, c AS (SELECT user_id, t, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS INT) AS j FROM e WHERE event_type = 'click'), q AS (SELECT user_id, t, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS INT) AS i FROM e WHERE event_type = 'purchase'),
x AS (SELECT user_id, i, j, row_number() OVER (PARTITION BY user_id ORDER BY abs(c.t - q.t), i, j) AS k FROM c JOIN q USING (user_id) WHERE abs(c.t - q.t) <= 86400000),
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST([] AS INT[]) AS a, CAST([] AS INT[]) AS b FROM c JOIN q USING (user_id) UNION ALL SELECT r.user_id, x.k, CASE WHEN list_contains(a, i) OR list_contains(b, j) THEN a ELSE list_append(a, i) END, CASE WHEN list_contains(a, i) OR list_contains(b, j) THEN b ELSE list_append(b, j) END FROM r JOIN x ON x.user_id = r.user_id AND x.k = r.k + 1),
m AS (SELECT user_id, (SELECT count(*) FROM c WHERE c.user_id = z.user_id) AS predicted, (SELECT count(*) FROM q WHERE q.user_id = z.user_id) AS truth, matched FROM (SELECT user_id, max(len(a)) AS matched FROM r GROUP BY user_id) z)
SELECT *, predicted - truth AS error, abs(predicted - truth) AS abs_error, abs(predicted - truth) <= 1 AS off_by_one, CAST(abs(predicted - truth) AS DOUBLE) / truth AS normalized_error, CAST(matched AS DOUBLE) / predicted AS precision, CAST(matched AS DOUBLE) / truth AS recall FROM m""")
def greedy_match_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


_COUNTS = f"""{EVENTS}, c AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS predicted, count(*) FILTER (event_type = 'purchase') AS truth, count(*) FILTER (event_type = 'view') AS views FROM e GROUP BY user_id),
s AS (SELECT *, least(predicted, truth, views) AS matched, abs(predicted - truth) AS abs_error, abs(predicted - truth) <= 1 AS obo, user_id % 3 AS grp, user_id % 5 = 0 AS amb FROM c)"""


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda k: F.count_if(F.col("event_type") == k)
    c = events(spark, sf_dir).groupBy("user_id").agg(n("click").alias("predicted"), n("purchase").alias("truth"), n("view").alias("views"))
    return metrics.count_metrics(c.withColumns({"matched": F.least("predicted", "truth", "views"), "grp": F.col("user_id") % 3}))


@query(f"""WITH {_COUNTS} SELECT grp AS scope, CAST(grouping(grp) AS INT) AS is_total, count(*) AS videos, round(avg(abs_error), 6) AS mae, round(avg(abs_error) FILTER (NOT amb), 6) AS clean_mae, round(avg(CASE WHEN obo THEN 1.0 ELSE 0 END), 6) AS obo, round(sum(matched) / nullif(sum(predicted), 0), 6) AS precision, round(sum(matched) / nullif(sum(truth), 0), 6) AS recall FROM s GROUP BY ROLLUP (grp)""")
def pooled_vs_mean_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.pooled(_counted(spark, sf_dir), "grp", F.col("user_id") % 5 == 0)
    return out.withColumns({c: r6(c) for c in ("mae", "clean_mae", "obo", "precision", "recall")})


@query(f"""WITH {_COUNTS} SELECT user_id, predicted - truth AS error, abs_error, obo AS off_by_one, round(abs_error / nullif(truth, 0), 6) AS normalized_error, round(matched / nullif(predicted, 0), 6) AS precision, round(matched / nullif(truth, 0), 6) AS recall FROM s""")
def count_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _counted(spark, sf_dir).select("user_id", "error", "abs_error", "off_by_one", "normalized_error", "precision", "recall")
    return out.withColumns({c: r6(c) for c in ("normalized_error", "precision", "recall")})


@query(f"""WITH {_COUNTS}, b AS (SELECT user_id AS video_id, truth, abs_error FROM s WHERE abs_error = 0 ORDER BY truth DESC, user_id LIMIT 1), w AS (SELECT user_id AS video_id, truth, abs_error FROM s WHERE abs_error > 0 ORDER BY abs_error DESC, user_id LIMIT 5)
SELECT * EXCLUDE r FROM (SELECT *, 0 AS r FROM b UNION ALL SELECT *, 1 FROM w) ORDER BY r, abs_error DESC, video_id LIMIT 5""")
def trace_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pick_traces(_counted(spark, sf_dir).select(F.col("user_id").alias("video_id"), "truth", "abs_error"), 5)


@query(f"""WITH {EVENTS}, g AS (SELECT CAST(row_number() OVER (ORDER BY d, u) - 1 AS INT) AS params, d, u FROM (SELECT unnest([10.0, 20.0, 30.0]) AS d) x CROSS JOIN (SELECT unnest([60.0, 80.0]) AS u) y),
p AS (SELECT params, user_id, t, event_id, coalesce(last_value(CASE WHEN value <= d THEN 'down' WHEN value >= u THEN 'up' END IGNORE NULLS) OVER (PARTITION BY params, user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'up') AS phase, event_type FROM e, g),
b AS (SELECT *, phase = 'up' AND lag(phase, 1, 'up') OVER (PARTITION BY params, user_id ORDER BY t, event_id) = 'down' AS back FROM p),
c AS (SELECT params, user_id, abs(count(*) FILTER (back) - count(*) FILTER (event_type = 'click')) AS err FROM b GROUP BY 1, 2)
SELECT params, round(avg(err), 6) AS mae, round(avg(CASE WHEN err <= 1 THEN 1.0 ELSE 0 END), 6) AS obo FROM c GROUP BY params""")
def param_grid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [(d, u) for d in (10.0, 20.0, 30.0) for u in (60.0, 80.0)]
    err = metrics.hysteresis_grid(events(spark, sf_dir), "user_id", ["t", "event_id"], "value", F.col("event_type") == "click", pairs)
    ranked = metrics.rank_parameters(err.withColumn("off_by_one", F.col("abs_error") <= 1))
    return ranked.select("params", r6("mae").alias("mae"), r6("obo").alias("obo"))


def _session(spark: SparkSession, sf_dir: str, odd: int | None = None) -> DataFrame:
    e = events(spark, sf_dir).where("event_type != 'view'")
    e = e if odd is None else e.where(F.col("event_id") % 2 == odd)
    return e.groupBy(F.col("user_id").cast("string").alias("video_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t.cast("string")), ";").alias("rep_timestamps_ms")).withColumn("label", F.lit("squat"))


@query(f"""WITH {EVENTS}, a AS (SELECT user_id, count(*) AS n FROM e WHERE event_type <> 'view' AND event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM e WHERE event_type <> 'view' AND event_id % 2 = 1 GROUP BY 1)
SELECT count(*) AS n_videos, round(avg(CASE WHEN a.n = b.n THEN 1.0 ELSE 0 END), 6) AS exact, round(avg(CASE WHEN abs(a.n - b.n) <= 1 THEN 1.0 ELSE 0 END), 6) AS off_by_one, round(avg(abs(a.n - b.n)), 6) AS mae FROM a JOIN b USING (user_id)""")
def session_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = sheets.agreement(_session(spark, sf_dir, 0), _session(spark, sf_dir, 1))
    return a.select("n_videos", r6("exact").alias("exact"), r6("off_by_one").alias("off_by_one"), r6("mae").alias("mae"))


@query(f"""WITH RECURSIVE {EVENTS}, w AS (SELECT user_id, t, event_id % 2 AS s, CAST(row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY t) - 1 AS INT) AS k FROM e WHERE event_type <> 'view'), n AS (SELECT user_id, count(*) FILTER (s = 0) AS a, count(*) FILTER (s = 1) AS b FROM w GROUP BY user_id),
r AS (SELECT user_id, 0 AS i, 0 AS j, 0 AS met FROM n WHERE a > 0 AND b > 0 UNION ALL SELECT r.user_id, r.i + CASE WHEN abs(x.t - y.t) <= 300 OR x.t < y.t THEN 1 ELSE 0 END, r.j + CASE WHEN abs(x.t - y.t) <= 300 OR x.t >= y.t THEN 1 ELSE 0 END, met + CASE WHEN abs(x.t - y.t) <= 300 THEN 1 ELSE 0 END FROM r JOIN w x ON x.user_id = r.user_id AND x.s = 0 AND x.k = r.i JOIN w y ON y.user_id = r.user_id AND y.s = 1 AND y.k = r.j)
SELECT CAST(n.user_id AS VARCHAR) AS video_id, a AS "first", b AS "second", b - a AS difference, round(CAST(met AS DOUBLE) / greatest(a, b, 1), 6) AS timing_match FROM n JOIN (SELECT user_id, max(met) AS met FROM r GROUP BY user_id) USING (user_id)""")
def session_agreement_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.agreement_rows(_session(spark, sf_dir, 0), _session(spark, sf_dir, 1)).withColumn("timing_match", r6("timing_match"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_totalprice AS v, o_orderstatus AS s, o_orderpriority AS p, o_orderdate AS d FROM orders)
SELECT id, 'low price' AS problem FROM o WHERE v < 10000 UNION ALL SELECT id, 'pending and urgent' FROM o WHERE s = 'P' AND p LIKE '1-%' UNION ALL SELECT id, 'early' FROM o WHERE d < TIMESTAMP '1995-02-01'""")
def row_rule_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = F.array_compact(F.array(F.when(F.col("o_totalprice") < 10000, "low price"), F.when((F.col("o_orderstatus") == "P") & F.col("o_orderpriority").startswith("1-"), "pending and urgent"), F.when(F.col("o_orderdate") < F.lit("1995-02-01").cast("timestamp_ntz"), "early")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.explode(rules).alias("problem"))


@query(f"""WITH {EVENTS}, s AS (SELECT user_id AS u, CAST(user_id AS VARCHAR) AS video_id, list_sort(list(t)) AS marks, count(*) AS n FROM e WHERE event_type <> 'view' GROUP BY user_id), k AS (SELECT * FROM s WHERE u % 13 <> 0)
SELECT video_id, 'video_id is not in the manifest' AS problem FROM s WHERE u % 13 = 0 UNION ALL SELECT video_id, 'label differs from the manifest' FROM k WHERE u % 11 = 0 UNION ALL SELECT video_id, 'is_ambiguous must be true or false' FROM k WHERE u % 9 = 0 UNION ALL SELECT video_id, 'rep_count differs from the number of marks' FROM k WHERE u % 4 = 0
UNION ALL SELECT video_id, 'marks do not rise' FROM k WHERE len(list_distinct(marks)) < n UNION ALL SELECT video_id, 'mark outside the video' FROM k WHERE marks[1] < 0 OR marks[n] > 1600000000250 UNION ALL SELECT video_id, 'hold fields of a rep exercise' FROM k WHERE u % 6 = 0""")
def label_sheet_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label rules on a sheet made from `events`: marks in whole seconds, some of them broken on purpose."""
    s = _session(spark, sf_dir)
    n = F.size(F.split("rep_timestamps_ms", ";"))
    odd = F.col("video_id").cast("int")
    sheet = s.select("video_id", F.when(odd % 11 == 0, "plank").otherwise("squat").alias("label"), F.when(odd % 4 == 0, n + 1).otherwise(n).cast("string").alias("rep_count"), "rep_timestamps_ms", F.lit("").alias("hold_start_ms"), F.when(odd % 6 == 0, "7").otherwise("").alias("hold_end_ms"), F.when(odd % 9 == 0, "maybe").otherwise("false").alias("is_ambiguous"), F.lit("").alias("notes"), F.lit("x").alias("labeler"), F.lit("2026-01-02T03:04:05Z").alias("labeled_at"))
    manifest = s.where(odd % 13 != 0).select("video_id", F.lit("squat").alias("label"), F.lit(1.6e9).alias("duration_s"))
    return sheets.label_problems(sheet, manifest)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id")
def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, known = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return d.join(known, "doc_id", "left_anti").orderBy("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 25")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", 25)


@query("""SELECT o_orderkey AS id, 'old' AS error FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 12 = 0""")
def error_log_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    old = o.where("o_orderstatus = 'O'").select("id", F.lit("old").alias("error"))
    return sinks.upsert_errors(old, o.where("id % 3 = 0"), o.where("id % 12 = 0").select("id", F.lit("new").alias("error")), "id")


@query("""WITH h AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT)) AS h FROM documents)
SELECT doc_id FROM h ORDER BY h, s LIMIT CAST((SELECT greatest(1, ceil(count(*) * 0.1)) FROM documents) AS BIGINT)""")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("s"))
    return split.hash_sample(d, "s").select("doc_id")


@query("""SELECT CASE WHEN regexp_matches(p_type, 'STEEL$') THEN 'steel' WHEN regexp_matches(p_type, '^(PROMO|SMALL)') THEN 'promo' WHEN regexp_matches(p_type, 'BRUSHED') THEN 'brushed' ELSE 'other' END AS bucket, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY 1, 2""")
def regex_bucket_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("steel", "STEEL$"), ("promo", "^(PROMO|SMALL)"), ("brushed", "BRUSHED")]
    return metrics.bucket_rollup(table(spark, sf_dir, "part").withColumn("brand", S.snake_case(F.col("p_brand"))), "p_type", "p_size", rules, "other", ["brand"])


@query("""SELECT n_name AS label, CAST(sum(5000) AS BIGINT) AS n_frames, CAST(sum(greatest(0, CAST(floor(c_acctbal) AS BIGINT))) AS BIGINT) AS n_detected, round(100.0 * sum(greatest(0, CAST(floor(c_acctbal) AS BIGINT))) / sum(5000), 6) AS detected_pct FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_name)""")
def rollup_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = c.select(F.col("n_name").alias("label"), F.lit(5000).cast("long").alias("n_frames"), F.greatest(F.lit(0).cast("long"), F.floor("c_acctbal").cast("long")).alias("n_detected"))
    return detection_rollup(rows).withColumn("detected_pct", r6("detected_pct"))


def _diverse_sql(k: int) -> str:
    """k rounds, each of which adds the best row of a label."""
    first = """c1 AS (SELECT v.* FROM v JOIN m USING (label) QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(abs(len - med), 12), turn, video_id) = 1)"""
    more = """c{1} AS (SELECT * FROM c{0} UNION ALL (SELECT v.* FROM v JOIN (SELECT v.video_id, bool_or(c.group_id = v.group_id) AS same_group, bool_or(c.ext = v.ext) AS same_kind, min(abs(v.len - c.len)) AS far FROM v JOIN c{0} c USING (label) GROUP BY v.video_id) s USING (video_id)
WHERE video_id NOT IN (SELECT video_id FROM c{0}) QUALIFY row_number() OVER (PARTITION BY label ORDER BY same_group, same_kind, round(far, 12) DESC, turn, video_id) = 1))"""
    return ", ".join([first, *[more.format(i, i + 1) for i in range(1, k)]])


@query(f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS video_id, lang AS label, source AS group_id, 'x' || doc_id % 4 AS ext, CAST(n_chars AS DOUBLE) AS duration_s FROM documents),
v AS (SELECT *, ln(greatest(0.1, coalesce(duration_s, median(duration_s) OVER (PARTITION BY label), 1))) AS len, md5('42:' || label || ':' || video_id) AS turn FROM d), m AS (SELECT label, median(len) AS med FROM v GROUP BY label), {_diverse_sql(5)}
SELECT video_id, label, group_id, ext, duration_s, CASE WHEN label IN ('plank') THEN 'hold' ELSE 'reps' END AS task FROM c5""")
def diverse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("video_id"), F.col("lang").alias("label"), F.col("source").alias("group_id"), F.concat(F.lit("x"), F.col("doc_id") % 4).alias("ext"), F.col("n_chars").cast("double").alias("duration_s"))
    return split.pick_diverse(pool, 5)


@query("""WITH u AS (SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 3 = 0) SELECT lang, count(*) AS n, count(DISTINCT doc_id) AS ids FROM u GROUP BY lang""")
def union_of_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return sheets.concatenated([d.where("doc_id % 2 = 0"), d.where("doc_id % 3 = 0")]).groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"))


@query("""SELECT o.doc_id, coalesce(i.v, o.v) AS v FROM (SELECT doc_id, quality AS v FROM labels) o LEFT JOIN (SELECT doc_id, 1 - quality AS v FROM labels WHERE doc_id % 4 = 0) i USING (doc_id)""")
def merge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("v"))
    return sheets.merge_labels(old, old.where("doc_id % 4 = 0").select("doc_id", (F.lit(1) - F.col("v")).alias("v")), "doc_id")


@query("SELECT doc_id FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT doc_id FROM labels)")
def session_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.in_both(table(spark, sf_dir, "documents").where("doc_id % 2 = 0"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def newest_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.newest(table(spark, sf_dir, "orders"), "o_orderdate", ties=["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT doc_id, CASE WHEN n_chars < 60000 THEN printf('%d:%02d', n_chars // 60, n_chars % 60) ELSE printf('%d:%02d', n_chars // 60, n_chars % 60) END AS length, CAST(round_even(n_chars * 1000 / 30, 0) AS BIGINT) AS ms, 1000.0 / 30 AS step FROM documents")
def scalar_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", S.duration_text(n * 1000).alias("length"), S.frame_millis(n, F.lit(30)).alias("ms"), S.frame_step(F.lit(0.0)).alias("step"))


@query("""SELECT event_id, user_id FROM events WHERE 30 <= 15 * 1.01 OR event_id = 0 OR floor(event_id * 0.5) <> floor((event_id - 1) * 0.5)""")
def downsample_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(S.keep_frame(F.col("event_id"), F.lit(30.0), 15.0)).select("event_id", "user_id")
