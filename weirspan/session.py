"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "weirspan") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; fall back to a scratch folder in local mode only."""
    if spark.sparkContext.getCheckpointDir():
        return
    shared = spark.conf.get(CHECKPOINT_KEY, None)
    if shared:
        spark.sparkContext.setCheckpointDir(shared)
    elif spark.sparkContext.master.startswith("local"):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    else:
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage so a lost executor does not replay the whole loop."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def merged(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: joined by merging, never broadcast.

    The planner guesses sizes from those of compressed files and leaves out what ``explode`` adds, so it may take millions
    of rows for a few MB and send them through the driver.
    """
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out evenly, or by the hash of ``keys``, over as many tasks as a shuffle of the session has, and no fewer than its cores.

    For thin inputs of costly row-wise work: the work then follows neither the layout of the files, nor the sizes of
    the keys, nor the bytes of the rows. The number is explicit, so adaptive execution doesn't join small parts again.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
