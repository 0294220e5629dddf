"""Checks after loading: shares, distinct counts, value counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _long(df: DataFrame, cols: list[str]) -> DataFrame:
    """One (column, dtype, value-as-text) row per cell."""
    types = dict(df.dtypes)
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"),
                 F.col(c).cast("string").alias("value"))
        for c in cols])
    return df.select(F.inline(cells))


def populated_share(df: DataFrame, cols: list[str]) -> DataFrame:
    wide = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "populated")


def profile_columns(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, null share and distinct count per column, in one pass.

    `approximate` keeps a mergeable sketch for each column in one aggregate, so what moves is one
    row a task. The exact count is of cells: cells are counted by (column, value) before anything meets on the column name, so the
    few column keys never gather raw cells. Many distinct counts in one aggregate would
    copy each row once per column and keep all copies through the shuffle.
    """
    if approximate:
        wide = df.agg(F.count("*").alias("_n"), *[x for i, c in enumerate(df.columns) for x in (
            F.count(F.col(c)).alias(f"_f{i}"), F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c).cast("string"), 14)).alias(f"_u{i}"))])
        counted = wide.select("_n", F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"_f{i}").alias("_filled"),
                     F.coalesce(F.col(f"_u{i}"), F.lit(0)).alias("n_unique")) for i, (c, t) in enumerate(df.dtypes)])))
    else:
        counted = (
            _long(df, df.columns).groupBy("column", "dtype", "value").agg(F.count("*").alias("_c"))
            .groupBy("column", "dtype").agg(
                F.sum("_c").alias("_n"),
                F.sum(F.when(F.col("value").isNotNull(), F.col("_c")).otherwise(0)).alias("_filled"),
                F.count("value").alias("n_unique"))
        )
    return counted.select("column", "dtype",
                          (1 - F.col("_filled") / F.col("_n")).alias("pct_null"), "n_unique")


def count_by(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *cols)


def top_k_by_count(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """The k most frequent non-null values."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), col).limit(k))


def season_count(df: DataFrame, date: str = "game_date") -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"),
                  F.count_distinct(F.year(date)).alias("n_seasons"))
