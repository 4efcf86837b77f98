"""Queries of label sheets, editing, file selection, splits and documents, over tables made from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.functions import scalars as S
from cadence.operators import evaluate, features, metrics, ordered, quality, split
from cadence.operators import labels as sheets
from cadence.plans.registry import EVENTS, events, query, r6, table
from cadence.sources import sinks, tables


@query("""WITH c AS (SELECT c_custkey AS k, 'c' || c_custkey AS video_id, CAST(CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_custkey % 70 * 1000 END AS BIGINT) AS s, CAST(c_custkey % 90 * 1000 AS BIGINT) AS e, c_custkey % 19 = 0 AS bad, c_custkey % 5 = 0 AS amb, (60 + c_custkey % 50) * 1000 + 250 AS last FROM customer)
SELECT video_id, problem FROM (
SELECT video_id, 'ambiguous without notes' AS problem FROM c WHERE amb AND k % 10 = 0 UNION ALL SELECT video_id, 'no labeler' FROM c WHERE k % 29 = 0 UNION ALL SELECT video_id, 'labeled_at is no ISO 8601 time' FROM c WHERE k % 31 = 0
UNION ALL SELECT video_id, 'rep fields of a hold exercise' FROM c WHERE k % 23 = 0 UNION ALL SELECT video_id, 'hold_start_ms or hold_end_ms is no integer' FROM c WHERE bad
UNION ALL SELECT video_id, 'hold_start_ms and hold_end_ms are required' FROM c WHERE NOT bad AND s IS NULL AND NOT amb
UNION ALL SELECT video_id, 'hold outside the video' FROM c WHERE NOT bad AND s IS NOT NULL AND NOT (s >= 0 AND s < e AND e <= last)
UNION ALL SELECT video_id, 'hold outside the video' FROM c WHERE NOT bad AND s IS NULL AND e > last)""")
def hold_sheet_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of hold exercises on a sheet in which every rule is broken somewhere."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").withColumn("video_id", F.concat(F.lit("c"), k.cast("string")))
    start = F.when(k % 19 == 0, "x").when(k % 17 == 0, "").otherwise((k % 70 * 1000).cast("string"))
    sheet = c.select("video_id", F.lit("plank").alias("label"), F.when(k % 23 == 0, "3").otherwise("").alias("rep_count"), F.lit("").alias("rep_timestamps_ms"), start.alias("hold_start_ms"), (k % 90 * 1000).cast("string").alias("hold_end_ms"), F.when(k % 5 == 0, "true").otherwise("false").alias("is_ambiguous"), F.when(k % 10 == 0, " ").otherwise("n").alias("notes"), F.when(k % 29 == 0, "").otherwise("me").alias("labeler"), F.when(k % 31 == 0, "yesterday").otherwise("2026-01-02T03:04:05Z").alias("labeled_at"))
    return sheets.label_problems(sheet, c.select("video_id", F.lit("plank").alias("label"), (F.lit(60) + k % 50).alias("duration_s")))


_EDITS = f"""{EVENTS}, l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i, CASE WHEN event_type = 'click' THEN 'undo' WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'ambiguous' WHEN event_type = 'purchase' AND event_id % 3 = 1 THEN 'hold_start' WHEN event_type = 'purchase' THEN 'hold_end' WHEN event_id % 17 = 0 THEN 'clear_hold' ELSE 'add' END AS kind, CAST(event_id * 37 % 4000 AS BIGINT) AS pos, event_id % 2 = 0 AS flag FROM e),
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS marks, CAST(NULL AS BIGINT) AS h0, CAST(NULL AS BIGINT) AS h1, false AS amb FROM l UNION ALL
SELECT r.user_id, l.i, CASE WHEN kind = 'add' AND len(list_filter(marks, lambda m: abs(m - pos) < 150)) = 0 THEN list_append(marks, pos) WHEN kind = 'undo' AND len(marks) > 0 THEN marks[1:len(marks) - 1] ELSE marks END,
CASE WHEN kind = 'hold_start' THEN pos WHEN kind = 'clear_hold' AND h1 IS NULL THEN NULL ELSE h0 END, CASE WHEN kind = 'hold_end' THEN pos WHEN kind = 'clear_hold' THEN NULL ELSE h1 END, CASE WHEN kind = 'ambiguous' THEN flag ELSE amb END FROM r JOIN l ON l.user_id = r.user_id AND l.i = r.i + 1),
f AS (SELECT CAST(user_id AS VARCHAR) AS video_id, list_sort(marks) AS marks, h0, h1, amb FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS last FROM r) WHERE last = 1)"""


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, e = F.col("event_type"), F.col("event_id")
    name = F.when(kind == "click", "undo").when((kind == "purchase") & (e % 3 == 0), "ambiguous").when((kind == "purchase") & (e % 3 == 1), "hold_start").when(kind == "purchase", "hold_end").when(e % 17 == 0, "clear_hold").otherwise("add")
    log = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("video_id"), F.struct("t", "event_id").alias("seq"), name.alias("kind"), (e * 37 % 4000).alias("at_ms"), (e % 2 == 0).alias("flag"), F.lit("").alias("text"))
    return sheets.replay_edits(log)


@query(f"""WITH RECURSIVE {_EDITS} SELECT video_id, array_to_string(marks, ';') AS marks, h0 AS hold_start_ms, h1 AS hold_end_ms, amb AS is_ambiguous, CASE WHEN amb THEN 'ambiguous' WHEN len(marks) > 0 OR (h0 IS NOT NULL AND h1 IS NOT NULL) THEN 'done' ELSE 'todo' END AS status FROM f""")
def edited_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit log replayed: marks with their spacing, undo, hold edges, ambiguity and the status that follows."""
    return _edited(spark, sf_dir).select("video_id", F.array_join("marks", ";").alias("marks"), "hold_start_ms", "hold_end_ms", "is_ambiguous", "status")


@query(f"""WITH RECURSIVE {_EDITS}, m AS (SELECT f.*, CAST(video_id AS BIGINT) % 3 = 0 AS hold, 2000 + 250 AS last FROM f)
SELECT video_id, problem FROM (SELECT video_id, 'ambiguous without notes' AS problem FROM m WHERE amb UNION ALL SELECT video_id, 'no marks' FROM m WHERE NOT hold AND len(marks) = 0 AND NOT amb UNION ALL SELECT video_id, 'mark outside the video' FROM m WHERE len(list_filter(marks, lambda x: x < 0 OR x > 2250)) > 0
UNION ALL SELECT video_id, 'hold is open' FROM m WHERE hold AND (h0 IS NULL OR h1 IS NULL) AND NOT amb UNION ALL SELECT video_id, 'hold ends before it starts' FROM m WHERE h0 >= h1)""")
def export_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = _edited(spark, sf_dir)
    manifest = edited.select("video_id", F.when(F.col("video_id").cast("long") % 3 == 0, "plank").otherwise("squat").alias("label"), F.lit(2.0).alias("duration_s"))
    return sheets.export_problems(edited, manifest)


@query(f"""WITH RECURSIVE {_EDITS} SELECT video_id, CASE WHEN CAST(video_id AS BIGINT) % 3 = 0 THEN 'plank' ELSE 'squat' END AS label, CASE WHEN CAST(video_id AS BIGINT) % 3 = 0 THEN '' ELSE array_to_string(marks, ';') END AS marks, h0 AS hold_start_ms, h1 AS hold_end_ms, amb AS is_ambiguous FROM f""")
def sheet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited labels written as rows of a sheet and read again; holds have no marks there."""
    edited = _edited(spark, sf_dir)
    names = edited.select("video_id", F.when(F.col("video_id").cast("long") % 3 == 0, "plank").otherwise("squat").alias("label"))
    back = sheets.from_sheet(sheets.to_sheet(edited, names, "me", F.lit("2026-01-02T03:04:05Z")))
    return back.select("video_id", "label", F.array_join("marks", ";").alias("marks"), "hold_start_ms", "hold_end_ms", "is_ambiguous")


@query("""SELECT CAST(d.doc_id AS VARCHAR) AS video_id, CASE WHEN quality = 1 THEN 'done' ELSE 'ambiguous' END AS status FROM documents d JOIN labels l USING (doc_id) WHERE NOT (quality = 0 AND toxic = 0)""")
def exported_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("video_id"), F.col("doc_id").alias("index"))
    status = F.when(F.col("quality") == 1, "done").when(F.col("toxic") == 1, "ambiguous").otherwise("todo")
    return sinks.export_labels(entries, table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("video_id"), status.alias("status")))


@query("""SELECT CASE WHEN o_orderstatus = 'O' THEN 'plank' ELSE 'squat-' || o_orderstatus END AS label, CASE WHEN o_orderstatus = 'O' THEN 'hold seconds' ELSE 'reps' END AS unit, count(*) AS n_videos, count(*) FILTER (o_orderkey % 7 = 0) AS n_ambiguous,
round(avg(CASE WHEN o_orderstatus = 'O' THEN (o_custkey + 500) / 1000.0 ELSE o_orderkey % 4 END), 6) AS mean, CAST(min(CASE WHEN o_orderstatus = 'O' THEN (o_custkey + 500) / 1000.0 ELSE o_orderkey % 4 END) AS DOUBLE) AS min, CAST(max(CASE WHEN o_orderstatus = 'O' THEN (o_custkey + 500) / 1000.0 ELSE o_orderkey % 4 END) AS DOUBLE) AS max FROM orders GROUP BY o_orderstatus""")
def label_class_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, hold = F.col("o_orderkey"), F.col("o_orderstatus") == "O"
    marks = F.array_join(F.transform(F.slice(F.array(*[F.lit(v) for v in ("10", "20", "30")]), F.lit(1), (k % 4).cast("int")), lambda v: v), ";")
    sheet = table(spark, sf_dir, "orders").select(F.when(hold, "plank").otherwise(F.concat(F.lit("squat-"), "o_orderstatus")).alias("label"), F.when(hold, "").otherwise(marks).alias("rep_timestamps_ms"), F.when(hold, "1000").otherwise("").alias("hold_start_ms"), F.when(hold, (F.col("o_custkey") + 1500).cast("string")).otherwise("").alias("hold_end_ms"), F.when(k % 7 == 0, "true").otherwise("false").alias("is_ambiguous"))
    return sheets.class_summary(sheet).withColumn("mean", r6("mean"))


@query("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS video_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def unlabelled_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("video_id"))
    return sheets.unlabelled(table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("video_id")), wanted)


_PART = "CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'val' ELSE 'test' END"


def _assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("video_id"), F.expr(_PART).alias("split"), F.col("lang").alias("label"), F.col("source").alias("group_id"), "n_chars", "doc_id")


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS video_id, {_PART} AS split FROM documents WHERE doc_id % 10 >= 7 AND doc_id % 6 <> 0""")
def clean_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _assignment(spark, sf_dir)
    manifest = a.select("video_id", F.when(F.col("doc_id") % 6 == 0, "unreadable").when(F.col("doc_id") % 6 != 1, "").alias("error"))
    return split.candidates(manifest, a).select("video_id", "split")


@query("""SELECT CAST(d.doc_id AS VARCHAR) AS video_id, CAST(CASE WHEN toxic = 1 THEN 0 ELSE 50 + quality END AS DOUBLE) AS detected_pct, toxic IS NOT NULL AND toxic = 1 AS dropped FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def known_zero_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates attached to a pool, and the pool parted by whether its rate is known to be zero."""
    rates = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("video_id"), F.when(F.col("toxic") == 1, 0.0).otherwise(F.lit(50.0) + F.col("quality")).alias("detected_pct"))
    kept, gone = split.by_known_rate(split.attach_rates(_assignment(spark, sf_dir).select("video_id"), rates))
    return kept.withColumn("dropped", F.lit(False)).unionByName(gone.withColumn("dropped", F.lit(True)))


_LABELLED = f"a AS (SELECT lang || '-' || n_chars % 90 AS label, {_PART} AS split FROM documents), n AS (SELECT label, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, count(*) AS total FROM a GROUP BY label)"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_counts(_assignment(spark, sf_dir).select(F.concat("label", F.lit("-"), (F.col("n_chars") % 90).cast("string")).alias("label"), "split"))


@query(f"WITH {_LABELLED} SELECT label, train, val, test, total FROM n")
def split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


@query(f"WITH {_LABELLED} SELECT label, 'small class' AS problem FROM n WHERE total < 10 UNION ALL SELECT label, 'no val' FROM n WHERE val = 0 UNION ALL SELECT label, 'no test' FROM n WHERE test = 0")
def split_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_exceptions(_counts(spark, sf_dir))


@query("SELECT size, count(*) AS groups FROM (SELECT n_chars, count(*) AS size FROM documents GROUP BY 1 HAVING count(*) > 1) GROUP BY size")
def group_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.group_histogram(table(spark, sf_dir, "documents").select(F.col("n_chars").alias("group_id")))


@query("SELECT label, n FROM (SELECT n_chars % 40 AS label, count(*) FILTER (doc_id % 5 = 0) AS n FROM documents GROUP BY 1) WHERE n < 5")
def class_shortfalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, "documents").select((F.col("n_chars") % 40).alias("label"), "doc_id")
    return split.shortfalls(pool, pool.where("doc_id % 5 = 0"), 5)


@query(f"WITH {EVENTS} SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM e) WHERE r = 1")
def first_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.first_label(events(spark, sf_dir), "user_id", "event_type", "event_id")


@query("SELECT l_partkey AS video_id, count(DISTINCT l_suppkey) AS paths FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def conflicting_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.conflicting_ids(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("video_id"), F.col("l_suppkey").alias("path")))


_KINDS = ["mov", "mp4", "avi", "webm", "m4v", "txt"]


@query(f"""WITH p AS (SELECT p_brand || '-' || p_size AS video_id, ({_KINDS!r})[p_partkey % 6 + 1] AS ext, 'f' || p_partkey AS path FROM part)
SELECT video_id, ext, path FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY coalesce(list_position(['mp4', 'webm', 'm4v', 'mov', 'avi', 'mkv'], ext), 7), path) AS r FROM p) WHERE r = 1""")
def preferred_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    files = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")).alias("video_id"), F.get(kinds, (F.col("p_partkey") % 6).cast("int")).alias("ext"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"))
    return tables.pick_files(files).select("video_id", "ext", "path")


@query("SELECT doc_id AS id, CAST(n_chars AS BIGINT) AS reps FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id + 1000000, 2 FROM documents WHERE doc_id % 4 <> 0")
def stored_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories stored as JSON texts of two sets each; what is no array is empty."""
    d = F.col("doc_id")
    text = F.when(d % 4 == 0, F.concat(F.lit("broken ["), d.cast("string"))).otherwise(F.format_string('[{"id":%d,"reps":%d},{"id":%d,"reps":2}]', d, F.col("n_chars"), d + 1000000))
    return tables.parse_history(table(spark, sf_dir, "documents").select(text.alias("text")), "text", "struct<id:bigint,reps:bigint>")


@query("""SELECT doc_id, md5(CASE WHEN regexp_matches(text, '[",\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END) AS field, printf('%.3f', n_chars / 8.0) AS chars, CASE WHEN doc_id % 3 = 0 THEN '' ELSE CAST(doc_id AS VARCHAR) END AS id FROM documents""")
def csv_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as CSV fields, numbers with fixed decimals, blanks for missing ones."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(sinks.quoted(F.col("text"))).alias("field"), sinks.fixed(F.col("n_chars") / 8, 3).alias("chars"), sinks.fixed(F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")), 0).alias("id"))


@query("""WITH x AS (SELECT o_orderkey AS id, o_custkey % 3000 + 1 AS w, o_orderkey % 2000 + 1 AS h FROM orders), y AS (SELECT *, least(1.0, CAST(640 AS DOUBLE) / greatest(w, h)) AS k FROM x)
SELECT id, CAST(greatest(1, round_even(w * k, 0)) AS INT) AS width, CAST(greatest(1, round_even(h * k, 0)) AS INT) AS height FROM y""")
def fitted_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = S.fit_within(F.col("o_custkey") % 3000 + 1, F.col("o_orderkey") % 2000 + 1, 640)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), size.alias("s")).select("id", "s.width", "s.height")


@query("SELECT event_id, ([0.5, 1.0, 2.0])[greatest(1, least(3, coalesce(list_position([0.5, 1.0, 2.0], CASE event_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 2.0 ELSE 7.0 END), 2) + CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END))] AS speed FROM events")
def next_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.get(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0), F.lit(7.0)), (F.col("event_id") % 4).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", S.next_speed(now, F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1)).alias("speed"))


@query("SELECT p_partkey, trim(regexp_replace(lower(trim(p_name || ' ' || p_type)), '[^a-z0-9]+', '_', 'g'), '_') AS name, printf('g%04d', p_partkey) AS grp FROM part")
def normalised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.snake_case(F.concat_ws(" ", "p_name", "p_type")).alias("name"), S.group_name(F.col("p_partkey")).alias("grp"))


@query(f"""WITH {EVENTS}, l AS (SELECT user_id, t, lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM e) SELECT user_id, coalesce(bool_and(p IS NULL OR t > p), true) AS rises FROM l GROUP BY user_id""")
def rising_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = events(spark, sf_dir).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "t"))), lambda x: x["t"]).alias("t"))
    return series.select("user_id", S.rises(F.col("t")).alias("rises"))


@query("""WITH v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS place FROM embeddings) SELECT vec_id, CAST(place AS INT) AS place, CASE WHEN (vec_id + place) % 9 <> 0 THEN round(CAST(x AS DOUBLE), 4) END AS x FROM v""")
def rounded_json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole vectors as JSON arrays of rounded numbers, NaN as null in place, and read again."""
    holed = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") + i) % 9 == 0, F.lit(float("nan"))).otherwise(x.cast("double")))
    back = F.from_json(S.rounded_json(holed, 4), "array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(back).alias("place", "x"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity - CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber ELSE 0 END AS BIGINT) || '/' || CAST(l_quantity AS BIGINT) AS badge, CASE WHEN l_returnflag = 'R' THEN 'hold' ELSE 'reps' END AS task FROM lineitem")
def set_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    warned = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber")).cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.set_badge(F.col("l_quantity").cast("long"), warned).alias("badge"), S.task_of(F.when(F.col("l_returnflag") == "R", "plank").otherwise("squat")).alias("task"))


def _doc_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return _assignment(spark, sf_dir).select("video_id", F.when(d % 8 == 0, "plank").otherwise("squat").alias("label"), F.when(d % 6 == 0, "").when(d % 6 == 1, "many").otherwise(F.col("n_chars").cast("string")).alias("rep_count"))


@query("SELECT CAST(doc_id AS VARCHAR) AS video_id, CAST(n_chars AS VARCHAR) AS rep_count FROM documents WHERE doc_id % 10 IN (7, 8) AND doc_id % 8 <> 0 AND doc_id % 6 > 1")
def rep_labels_of_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.labels_of_split(_doc_sheet(spark, sf_dir), _assignment(spark, sf_dir), "val").select("video_id", "rep_count")


@query("SELECT CAST(doc_id AS VARCHAR) AS video_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def videos_without_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("video_id"))
    return evaluate.missing_frames(_doc_sheet(spark, sf_dir), frames)


_RUNNING = f"{EVENTS}, c AS (SELECT user_id, t, event_id, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM e)"


@query(f"WITH {_RUNNING} SELECT user_id, event_id, n FROM (SELECT *, lag(n, 1, 0) OVER (PARTITION BY user_id ORDER BY t, event_id) AS b FROM c) WHERE n > b")
def count_rises(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    counted = events(spark, sf_dir).withColumn("n", F.count_if(F.col("event_type") == "purchase").over(w))
    return ordered.count_rises(counted, "user_id", ["t", "event_id"], "n").select("user_id", "event_id", "n")


@query("WITH n AS (SELECT max(doc_id) + 1 AS n FROM documents) SELECT doc_id AS next FROM documents, n WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY (doc_id - 101 + n) % n LIMIT 1")
def next_open_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    done = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("done"))
    n = d.agg(F.max("doc_id") + 1).first()[0]
    return ordered.next_open(d.join(done, "doc_id", "left"), "doc_id", F.coalesce("done", F.lit(False)), 100, n)


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, 0.5 + vec_id % 5 * 0.25 AS k FROM embeddings), p AS (SELECT vec_id, e, CAST(unnest(range(0, len(e))) AS INT) AS place, k FROM v), q AS (SELECT *, least(CAST(place * k AS DOUBLE), len(e) - 1) AS pos FROM p)
SELECT vec_id, place, round(e[CAST(floor(pos) AS INT) + 1] + (e[least(CAST(floor(pos) AS INT) + 1, len(e) - 1) + 1] - e[CAST(floor(pos) AS INT) + 1]) * (pos - floor(pos)), 6) AS x FROM q""")
def time_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"), (F.lit(0.5) + F.col("vec_id") % 5 * F.lit(0.25)).alias("k"))
    return v.select("vec_id", F.posexplode(ordered.time_scale(F.col("e"), F.col("k"))).alias("place", "x")).withColumn("x", r6("x"))


@query("SELECT CAST(row_number() OVER (ORDER BY source) - 1 AS INT) AS y, source AS label FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def label_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.vocabulary(table(spark, sf_dir, "documents").select(F.col("source").alias("label")))


@query("""WITH c AS (SELECT n_name AS label, CAST(sum(greatest(0, CAST(floor(c_acctbal) AS BIGINT))) AS DOUBLE) AS d, count(*) * 5000 AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1), t AS (SELECT 100.0 * sum(d) / sum(n) AS whole FROM c),
w AS (SELECT n_name AS label FROM nation UNION ALL SELECT 'ATLANTIS') SELECT label, round(100.0 * d / n, 6) AS detected_pct, round(whole, 6) AS overall_pct, CASE WHEN d IS NULL THEN 'unknown' WHEN 100.0 * d / n < whole THEN 'below' ELSE 'not below' END AS context FROM w LEFT JOIN c USING (label), t""")
def class_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = c.select(F.col("n_name").alias("label"), F.lit(5000).cast("long").alias("n_frames"), F.greatest(F.lit(0).cast("long"), F.floor("c_acctbal").cast("long")).alias("n_detected"))
    worst = table(spark, sf_dir, "nation").select(F.col("n_name").alias("label")).unionByName(spark.range(1).select(F.lit("ATLANTIS").alias("label")))
    out = quality.class_context(worst, tables.detection_rollup(rows))
    return out.withColumns({"detected_pct": r6("detected_pct"), "overall_pct": r6("overall_pct")})


@query("""WITH f AS (SELECT s AS stream_id, CAST(i AS INT) AS frame_idx, i / 30.0 AS t FROM range(40) x(s), range(360) y(i)), p AS (SELECT *, greatest(0.0, least(t - 1.0, 10.0)) / 2.0 AS phase FROM f)
SELECT stream_id, frame_idx, CAST(floor(t * 1000 + 0.5) AS BIGINT) AS ts_ms, round(0.5 * (1 - cos(phase * 6.283185307179586)) / 2, 6) AS value FROM p""")
def synthetic_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.synthetic_movement(spark, 40).withColumn("value", r6("value"))


_MARKS = f"""{EVENTS}, c AS (SELECT user_id, t, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS INT) AS j FROM e WHERE event_type = 'click'), q AS (SELECT user_id, t, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS INT) AS i FROM e WHERE event_type = 'purchase')"""


@query(f"""WITH RECURSIVE {_MARKS}, x AS (SELECT user_id, i, j, row_number() OVER (PARTITION BY user_id ORDER BY abs(c.t - q.t), i, j) AS k FROM c JOIN q USING (user_id) WHERE abs(c.t - q.t) <= 86400000),
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST([] AS INT[]) AS a, CAST([] AS INT[]) AS b FROM c JOIN q USING (user_id) UNION ALL SELECT r.user_id, x.k, CASE WHEN list_contains(a, i) OR list_contains(b, j) THEN a ELSE list_append(a, i) END, CASE WHEN list_contains(a, i) OR list_contains(b, j) THEN b ELSE list_append(b, j) END FROM r JOIN x ON x.user_id = r.user_id AND x.k = r.k + 1)
SELECT user_id, max(len(a)) AS matched FROM r GROUP BY user_id""")
def closest_first_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    times = lambda kind, name: e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.array_sort(F.collect_list("t")).alias(name))
    both = times("click", "p").join(times("purchase", "t"), "user_id")
    return both.select("user_id", F.size(sheets.greedy_matches(F.col("p"), F.col("t"), 86_400_000)).alias("matched"))


@query(f"""WITH RECURSIVE {_MARKS}, n AS (SELECT user_id, (SELECT count(*) FROM c WHERE c.user_id = u.user_id) AS n, (SELECT count(*) FROM q WHERE q.user_id = u.user_id) AS m FROM (SELECT DISTINCT user_id FROM c) u),
r AS (SELECT user_id, 0 AS j, 0 AS i, 0 AS met FROM n WHERE m > 0 UNION ALL SELECT r.user_id, r.j + CASE WHEN abs(c.t - q.t) <= 3600000 OR c.t < q.t THEN 1 ELSE 0 END, r.i + CASE WHEN abs(c.t - q.t) <= 3600000 OR c.t >= q.t THEN 1 ELSE 0 END, met + CASE WHEN abs(c.t - q.t) <= 3600000 THEN 1 ELSE 0 END FROM r JOIN c ON c.user_id = r.user_id AND c.j = r.j JOIN q ON q.user_id = r.user_id AND q.i = r.i)
SELECT user_id, max(met) AS matched FROM r GROUP BY user_id""")
def pointer_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of two series paired by walking both at once, one hour apart at most."""
    e = events(spark, sf_dir)
    times = lambda kind, name: e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.array_sort(F.collect_list("t")).alias(name))
    both = times("click", "a").join(times("purchase", "b"), "user_id")
    return both.select("user_id", sheets.pointer_matches(F.col("a"), F.col("b"), 3_600_000).alias("matched"))


@query("SELECT video_id, count(*) AS n FROM (SELECT CAST(doc_id AS VARCHAR) AS video_id FROM documents) GROUP BY video_id")
def key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.count_share(_assignment(spark, sf_dir), "video_id").select("video_id", "n")


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS r FROM customer) WHERE r = 1")
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.latest_by(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), "c_nationkey", "c_custkey")
