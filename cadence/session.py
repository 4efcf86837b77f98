"""Session helpers: the one place that decides about checkpoint folders, Arrow batch sizes and shuffles after unions."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch on its way to a Python worker. Spark's own bound counts rows only, which says nothing
#: about memory when a row holds a whole text or a packed block.
ARROW_BATCH_BYTES = 8 << 20


def local_session(app: str = "cadence", cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks. Clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineages: spark.checkpoint.dir, or a temporary one in local mode only."""
    sc = spark.sparkContext
    if (now := sc.getCheckpointDir()) is not None:
        return now
    shared = sc.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="cadence-checkpoint-")
    sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, stored in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bound_arrow(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes unless the session already has a tighter bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key, str(2**31 - 1)))
    if not now.isdigit() or int(now) > ARROW_BATCH_BYTES:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


def keep_repartition(spark: SparkSession) -> None:
    """Bring the rows of a key together after a union as well. Spark 4.1 takes a union of inputs partitioned alike for
    partitioned and leaves the `repartition` after it out, yet adaptive execution then coalesces each input by its own size,
    so that rows of a key end up in different tasks."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
