"""Secret scanning through a ledger of blobs (operator 7). DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.session import cut


@dataclass(frozen=True)
class Rule:
    """A pattern, the group whose length counts, and the least length; matches that fail are consumed and dropped.
    `version` goes up with every change of the rule, so that blobs are scanned again for it."""

    name: str
    pattern: str
    group: int
    least: int
    version: int = 1


# The base rules, in the order in which kinds are listed.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = (
    Rule("assign", ASSIGN, 2, 8),
    Rule("access", r"(AKIA[A-Z0-9]+)", 1, 16),
    Rule("hex", r"([0-9a-f]+)", 1, 32),
)
#: Kinds beyond the base ones: private key headers and prefixed personal tokens.
MORE_RULES = (
    Rule("pem", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 1),
    Rule("prefixed", r"(gh[pousr]_[A-Za-z0-9]+)", 1, 40),
)
RULES = BASE_RULES + MORE_RULES
#: Paths of one blob are dealt to so many parts when findings are joined back; only blobs with findings are repeated.
SALTS = 16
#: Parts in which the query's documents reach the ledger; every document is in one of them.
DELIVERIES = 2
LEDGER = "blob string, rule string, rule_version int, spans array<struct<start:long,end:long>>"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _screen(rule: Rule) -> str:
    """A pattern that holds wherever a match of the rule survives; only such texts are taken apart."""
    if rule.name == "hex":
        return "[0-9a-f]{%d}" % rule.least
    return rule.pattern


def _hits(rule: Rule) -> Column:
    """Every match of a rule with the text before it, in order: splitting and extracting walk through the same matches."""
    text = F.col("text")
    zipped = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("part"),
    )
    made = F.transform(zipped, lambda x, i: F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("rule_version"), i.alias("n"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), (F.length(x["part"]) >= rule.least).alias("good")))
    found = F.filter(made, lambda x: x["size"].isNotNull())
    none = F.array().cast("array<struct<rule:string,rule_version:int,n:int,gap:int,size:int,good:boolean>>")
    return F.when(F.array_contains("todo", rule.name) & text.rlike(_screen(rule)), found).otherwise(none)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows (blob, rule, rule_version, spans) for what the ledger lacks and where something was found.

    versions(text, ...): every historical version of every path. Texts are addressed by the SHA-256 of their content and
    scanned once, however many paths and versions share one; pairs of blob and rule version that the ledger has are left
    out. Positions are code points: the n-th match starts after all gaps and matches before it, which a running sum over
    the few matches gives. A blob that many versions share is collapsed before the shuffle.
    """
    blobs = versions.select(blob_of(F.col("text")).alias("blob"), F.coalesce(F.col("text"), F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    every = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        blobs = blobs.withColumn("todo", every)
    else:
        current = F.lit(False)
        for r in rules:
            current = current | ((F.col("rule") == r.name) & (F.col("rule_version") == r.version))
        done = ledger.where(current).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        blobs = blobs.join(done, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("done", F.array().cast("array<string>")))).where(F.size("todo") > 0)
    hits = blobs.select("blob", F.explode(F.concat(*[_hits(r) for r in rules])).alias("h")).select("blob", "h.*")
    upto = Window.partitionBy("blob", "rule", "rule_version").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = hits.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("size")).over(upto)).where("good")
    return placed.groupBy("blob", "rule", "rule_version").agg(F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("size")).alias("start"), F.col("end").alias("end")))).alias("spans"))


def ledger_rows(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows to append to the ledger after a scan, also for pairs in which nothing was found."""
    names = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version")) for r in rules])
    pairs = versions.select(blob_of(F.col("text")).alias("blob")).distinct().select("blob", F.explode(names).alias("r")).select("blob", "r.*")
    keys = ["blob", "rule", "rule_version"]
    if ledger is not None:
        pairs = pairs.join(ledger, keys, "left_anti")
    none = F.array().cast("array<struct<start:long,end:long>>")
    return pairs.join(scan_unseen(versions, ledger, rules), keys, "left").select(*keys, F.coalesce("spans", none).alias("spans"))


def extend_ledger(ledger: DataFrame | None, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with rows for what it lacked of `versions`; the new rows are stored in the shared folder."""
    new = cut(ledger_rows(versions, ledger, rules))
    return new if ledger is None else ledger.unionByName(new)


def _count(name: str) -> Column:
    return F.size(F.filter("found", lambda s: s["rule"] == name))


def report(versions: DataFrame, id_cols: list[str], findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings (rows of a ledger) of current rule versions joined back to all paths; see `find_secrets`."""
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.name), F.lit(k))])
    current = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.version))])
    found = findings.where((F.size("spans") > 0) & (F.col("rule_version") == current[F.col("rule")]))
    each = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("rule")].alias("kind"), F.col("rule").alias("rule"), s["end"].alias("end")))
    by_blob = found.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(each))).alias("found"))
    paths = versions.select(*id_cols, blob_of(versions["text"]).alias("blob"), F.pmod(F.xxhash64(*id_cols), F.lit(SALTS)).alias("salt"))
    by_blob = by_blob.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    none = F.array().cast("array<struct<start:long,kind:int,rule:string,end:long>>")
    joined = paths.join(by_blob, ["blob", "salt"], "left").withColumn("found", F.coalesce("found", none))
    counts = [_count(r.name).cast("long").alias(f"n_{r.name}") for r in rules]
    return joined.select(*id_cols, *counts, "found")


def find_secrets(versions: DataFrame, id_cols: list[str], ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of `versions`, in any number of copies: its id columns, `n_<rule>` per rule and `found`, the array of
    (start, kind, rule, end) in order of start and then of the rules' order.

    Null text counts as empty; ids may be null or repeat; other columns are not read, whatever their names; an empty
    table gives no rows. Findings of earlier scans come from the ledger, as long as their rule version is current.
    """
    found = scan_unseen(versions, ledger, rules)
    if ledger is not None:
        found = found.unionByName(ledger.select("blob", "rule", "rule_version", "spans"))
    return report(versions, id_cols, found, rules)


def _line(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents come as DELIVERIES: the blobs of each are scanned as far as the ledger lacks them, and their rows, empty
    ones too, are added to it. All paths are then read off the ledger; texts are not scanned again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ledger = None
    for k in range(DELIVERIES):
        ledger = extend_ledger(ledger, docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(DELIVERIES)) == k))
    base = F.filter("found", lambda s: s["kind"] < len(BASE_RULES))
    return report(docs, ["doc_id"], ledger).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_line(base), 256).alias("base_sha256"), _line(F.col("found")).alias("spans"))


def _sql() -> str:
    parts = []
    for k, r in enumerate(RULES):
        rx = r.pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, {k} AS k, '{r.name}' AS rule, {r.least} AS least, unnest(list_zip(range(1, 1 + len(regexp_extract_all(t, '{rx}', 0))), string_split_regex(t, '{rx}')[:len(regexp_extract_all(t, '{rx}', 0))], regexp_extract_all(t, '{rx}', 0), regexp_extract_all(t, '{rx}', {r.group}))) AS z FROM d")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
z AS ({' UNION ALL '.join(parts)}),
p AS (
  SELECT doc_id, k, rule, length(z[4]) >= least AS good, length(z[3]) AS n,
         CAST(sum(length(z[2]) + length(z[3])) OVER (PARTITION BY doc_id, k ORDER BY z[1]) AS BIGINT) AS e FROM z
), f AS (SELECT doc_id, k, e - n AS s, rule || ':' || CAST(e - n AS VARCHAR) || ':' || CAST(e AS VARCHAR) AS span FROM p WHERE good),
g AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(span, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY s, k) AS spans FROM f GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


OP7_SQL = _sql()
