"""Capped water-filling of sources to target weights, with seeded repetitions (operator 9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.session import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the seeded hash that make a cell. Sizes are summed by source and cell first; only the one cell in which
#: a source's share ends is put in order.
CELL_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, epochs: float) -> DataFrame:
    """sources(source, source_size, weight) with `target`: shares of the total size by weight, none above `epochs` times
    its size; the excess goes to the others by weight, again and again.

    The end of that process has one water level: sources in ascending order of cap / weight are at their cap as long as
    the level that the rest would have lies above; so running sums over the sources give it at once. The window holds
    one row per source.
    """
    cap = F.col("source_size") * F.lit(float(epochs))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    leveled = (
        sources.withColumn("cap", cap)
        .withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
        .withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
        .withColumn("last", F.max(F.when(~F.col("full"), F.col("level"))).over(every))
    )
    target = F.when(F.col("full") | F.col("last").isNull(), F.col("cap")).otherwise(F.col("last") * F.col("weight"))
    return leveled.select("source", "source_size", "weight", target.cast("double").alias("target"))


def cycle_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1 .. cycle, repeating, to sources in order of their code points (UTF-8 order), null last."""
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", number % cycle + 1)


def plan_mix(docs: DataFrame, weights: DataFrame | None = None, epochs: float = 3.0, seed: int = 9, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken and what a copy needs): the words that the mix takes of each document.

    With r = target / source_size, each document is taken floor(r) times whole. The fraction that is left is filled with
    whole documents in the order of a seeded hash until the source's target is met; the one document in which it is met
    gives its leading words only. So a source takes its target to the nearest word. Sizes are summed per source and
    hash cell first; only the cell in which a source's share ends is ordered, so a source with a third of all rows is
    ordered in one 4096th of it. Only ids, sources and sizes are shuffled, never texts.

    weights(source, weight) replaces the cycle of 1, 2, 3. Null text has size 0; null is a source of its own; equal
    ids are told apart by their text's hash and, if they are whole repeats, by a row number; words of long texts are counted
    whole; ties of the hash go by id; other columns are not read; empty tables give no rows.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("twin").cast("string")))
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), word_count(docs[text_col]).alias("size"), F.xxhash64(docs[text_col]).alias("key"))
    twins = Window.partitionBy("doc_id", "key", "source").orderBy("size")
    slim = cut(slim.withColumn("twin", F.row_number().over(twins) - 1).withColumn("hash", h))
    sums = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        sums = cycle_weights(sums)
    else:
        w = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double").alias("weight"))
        sums = sums.join(w, F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source")
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    goals = water_fill(sums, epochs).withColumn("whole", F.floor(ratio + F.lit(1e-12))).withColumn("extra", F.greatest(F.lit(0), F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")))
    goals = goals.select(F.col("source").alias("g_source"), "source_size", "target", "whole", "extra")
    slim = slim.withColumn("cell", F.substring("hash", 1, CELL_DIGITS))
    cells = slim.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("cell_size").over(upto), F.lit(0)))
    cells = cells.join(goals, F.col("source").eqNullSafe(F.col("g_source")))
    cells = cells.select("g_source", F.col("cell").alias("g_cell"), "source_size", "target", "whole", "extra", "before", (F.col("before") + F.col("cell_size")).alias("after"))
    rows = slim.join(cells, F.col("source").eqNullSafe(F.col("g_source")) & (F.col("cell") == F.col("g_cell")))
    ends = (F.col("before") < F.col("extra")) & (F.col("after") > F.col("extra"))
    order = Window.partitionBy("g_source", "g_cell", "ends").orderBy("hash", "doc_id", "key", "twin").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.withColumn("ends", ends).where("ends").withColumn("sofar", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    edge = edge.withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("extra") - F.col("sofar"))))
    rest = rows.where(~ends).withColumn("part", F.when(F.col("after") <= F.col("extra"), F.col("size")).otherwise(0))
    columns = ["doc_id", "key", "twin", "size", "source_size", "target", "whole", "part"]
    planned = rest.select(*columns).unionByName(edge.select(*columns))
    return planned.withColumn("taken", (F.col("whole") * F.col("size") + F.col("part")).cast("long"))


def leading_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.concat_ws("", F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), n.cast("int")))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: each document as often as the plan takes it whole, and once more with its leading words
    where a source's share ends inside it. Columns as in `docs`; documents without words are kept once. Rows that share id,
    text and source are told apart by a hash of their other columns, so reruns agree; rows that share those too are alike.
    They are numbered only where there are any, which saves a shuffle of all texts and changes nothing else."""
    plan = plan_mix(docs, **options).select(F.col("doc_id").alias("p_id"), F.col("key").alias("p_key"), F.col("twin").alias("p_twin"), F.col("size").alias("p_size"), F.col("whole").alias("p_whole"), "part")
    others = [docs[f.name] for f in docs.schema if f.name not in ("doc_id", "text", "source") and "map<" not in f.dataType.simpleString()]
    twins = Window.partitionBy("doc_id", "p_text_key", "source").orderBy("p_rest")
    names = docs.columns
    repeated = plan.where("p_twin > 0").limit(1).count() > 0
    keyed = docs.withColumns({"p_text_key": F.xxhash64("text"), "p_rest": F.xxhash64(F.lit(0), *others)})
    keyed = keyed.withColumn("p_row", F.row_number().over(twins) - 1) if repeated else keyed.withColumn("p_row", F.lit(0))
    joined = keyed.join(plan, keyed.doc_id.eqNullSafe(plan.p_id) & (keyed.p_text_key == plan.p_key) & (keyed.p_row == plan.p_twin))
    whole = F.when(F.col("p_size") == 0, F.lit(1)).otherwise(F.col("p_whole") + (F.col("part") == F.col("p_size")).cast("int")).cast("int")
    cut_off = (F.col("part") > 0) & (F.col("part") < F.col("p_size"))
    copies = F.concat(F.array_repeat(F.lit(False), whole), F.array_repeat(F.lit(True), cut_off.cast("int")))
    spread = joined.withColumn("p_cut", F.explode(copies))
    short = leading_words(F.col("text"), F.col("part"))
    changed = {"text": F.when(F.col("p_cut"), short).otherwise(F.col("text"))}
    if "n_chars" in names:
        changed["n_chars"] = F.when(F.col("p_cut"), F.length(short).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return spread.withColumns(changed).select(*names)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('9:' || CAST(doc_id AS VARCHAR) || ':0') AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source
), l AS (
  SELECT *, 3.0 * source_size AS cap,
         (sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS level
  FROM s WINDOW p AS (ORDER BY CAST(3.0 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, CAST(CASE WHEN cap <= level * w THEN cap ELSE w * max(CASE WHEN cap > level * w THEN level END) OVER () END AS DOUBLE) AS target FROM l
), g AS (
  SELECT *, CAST(floor(CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END + 1e-12) AS BIGINT) AS whole FROM t
), b AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, greatest(0, CAST(round(g.target - g.whole * g.source_size) AS BIGINT)) AS extra,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, extra - before)) AS BIGINT) AS taken FROM b
"""
