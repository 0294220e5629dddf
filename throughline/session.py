"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cpus: int | str = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the local bench. A cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("throughline")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints and written intermediates.

    Only a local session without the setting gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if named is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            named = tempfile.mkdtemp(prefix="run-")
        spark.sparkContext.setCheckpointDir(named)
    return named or current


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from the written rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, *partition_by: str, moved: bool = True) -> DataFrame:
    """Write `df` as parquet in the shared folder and return the written table.

    For rows that several later branches read: they are computed once, a lost executor
    costs a re-read, and readers still get column pruning and pushed filters. With partition
    columns the rows are rebalanced by them first, which keeps the number of files in line
    with the bytes instead of tasks times partitions; not `moved`, each task writes its own.
    """
    path = scratch(df.sparkSession, name)
    rows = df.hint("rebalance", *[F.col(p) for p in partition_by]) if partition_by and moved else df
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one task where windows sort whole rows.
TASK_ROWS = 200_000


def task_count(spark: SparkSession, rows: int) -> int:
    """Partitions for so many wide rows: at most `TASK_ROWS` in each on average, whatever the session's setting, so that their sorts stay in memory."""
    return max(2, min(spark.sparkContext.defaultParallelism, rows // 25_000), -(-rows // TASK_ROWS))


def small_side(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """`df` written and counted: hinted for broadcast if it is small, a plain join side if not."""
    written = stage(df, "side")
    return F.broadcast(written) if written.count() <= max_rows else written
