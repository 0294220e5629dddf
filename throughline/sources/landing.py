"""Season files in, one season-partitioned table out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from throughline.config import PITCH, Cols
from throughline.sources.schema import PITCH_LOG, REQUIRED


class MissingFields(ValueError):
    """A log lacks columns that the analysis relies on."""


def conform(df: DataFrame, schema: T.StructType = PITCH_LOG) -> DataFrame:
    """Known columns cast to the pinned types; absent ones left out, the rest dropped."""
    present = [f for f in schema.fields if f.name in df.columns]
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in present])


def season_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths a glob matches, in order. Season files are few; their contents are not read."""
    found = spark.read.format("binaryFile").load(pattern).select("path")
    return [r.path for r in found.orderBy("path").collect()]


def load_log(spark: SparkSession, paths: str | list[str],
             schema: T.StructType = PITCH_LOG) -> DataFrame:
    """Stack season files, given as a glob or as paths. Each is read and cast on its own: pandas
    may have typed one column differently from season to season, which a merged read refuses."""
    out = None
    for p in season_files(spark, paths) if isinstance(paths, str) else paths:
        one = conform(spark.read.parquet(p), schema)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no season files at {paths!r}")
    return out


def required_report(df: DataFrame, fields: list[str] = REQUIRED) -> list[tuple[str, bool]]:
    return [(f, f in df.columns) for f in fields]


def check_required(df: DataFrame, fields: list[str] = REQUIRED, strict: bool = True) -> list[str]:
    missing = [f for f, there in required_report(df, fields) if not there]
    if missing and strict:
        raise MissingFields(f"missing expected columns: {missing}")
    return missing


def season_window(df: DataFrame, first: int, last: int, start_md: str = "03-15",
                  end_md: str = "11-30", c: Cols = PITCH) -> DataFrame:
    """Rows inside each season's calendar window, as date ranges that reach the scan."""
    keep = F.lit(False)
    for y in range(first, last + 1):
        keep = keep | F.col(c.date).between(F.lit(f"{y}-{start_md}").cast("date"),
                                            F.lit(f"{y}-{end_md}").cast("date"))
    return df.filter(keep)


def landed(spark: SparkSession, root: str) -> DataFrame | None:
    """Seasons already written, from the partition folders; None before the first landing."""
    try:
        return spark.read.parquet(root).select("season").distinct()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _write(df: DataFrame, root: str, c: Cols) -> None:
    """Rebalanced by season: adaptive execution splits a large season over as many writers as
    its bytes need and merges small ones. Rows in a file are sorted by the natural key, so
    min/max statistics prune."""
    (
        df.hint("rebalance", F.col(c.season)).sortWithinPartitions(c.season, *c.key)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(c.season).parquet(root)
    )


def land_log(df: DataFrame, root: str, c: Cols = PITCH) -> None:
    """Write the seasons that are not there yet; seasons already landed stay untouched."""
    there = landed(df.sparkSession, root)
    if there is not None:
        df = df.join(F.broadcast(there), c.season, "left_anti")  # a handful of years
    _write(df, root, c)


def land_season(df: DataFrame, root: str, season: int, c: Cols = PITCH) -> bool:
    """Land one season; False if it was already there."""
    there = landed(df.sparkSession, root)
    if there is not None and not there.filter(F.col("season") == season).isEmpty():
        return False
    one = df if c.season in df.columns else df.withColumn(c.season, F.year(c.date))
    _write(one.filter(F.col(c.season) == season), root, c)
    return True


def combined_table(df: DataFrame, root: str, c: Cols = PITCH) -> DataFrame:
    """All seasons in one table, sorted within files by the natural key."""
    _write(df if c.season in df.columns else df.withColumn(c.season, F.year(c.date)), root, c)
    return load_landed(df.sparkSession, root)


def load_landed(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


def landing_summary(spark: SparkSession, root: str,
                    expected: list[int] | None = None) -> DataFrame:
    """Rows, columns, files and bytes per season, with one total row (null season).

    A season in `expected` that brought nothing is reported with zero rows.
    """
    df = spark.read.parquet(root)
    width = len(df.columns)
    files = df.groupBy("season", F.col("_metadata.file_path").alias("_path")).agg(
        F.count("*").alias("_rows"), F.max("_metadata.file_size").alias("_bytes"))
    out = files.rollup("season").agg(
        F.sum("_rows").alias("rows"), F.lit(width).alias("cols"),
        F.count("*").alias("files"), F.sum("_bytes").alias("bytes"))
    if expected:
        wanted = spark.createDataFrame([(y,) for y in expected], "season int")
        empty = wanted.join(out, "season", "left_anti").select(
            "season", F.lit(0).cast("long").alias("rows"), F.lit(width).alias("cols"),
            F.lit(0).cast("long").alias("files"), F.lit(0).cast("long").alias("bytes"))
        out = out.unionByName(empty)
    return out
