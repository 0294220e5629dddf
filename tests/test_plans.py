"""Plan shape: what the optimizer gets to push down, and how often the log is moved."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from throughline.plans.catalog import CATALOG
from throughline.plans.study import study_rows
from throughline.session import scratch
from throughline.sources import landing
from throughline.sources.adapter import pitch_log


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def large(spark):
    """Plan as for tables too large to broadcast, without runtime re-planning."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_season_filter_prunes_partitions_and_columns(spark, sf):
    text = plan(study_rows(spark, sf).filter("season = 2000").select("reward"))
    assert re.search(r"PartitionFilters: \[.*season", text)
    assert re.search(r"ReadSchema: struct<reward:double>", text)


def test_season_window_reaches_the_scan(spark, sf):
    root = scratch(spark, "log")
    pitch_log(spark, sf).write.parquet(root)
    text = plan(landing.season_window(spark.read.parquet(root), 1996, 1997).select("game_pk"))
    assert "GreaterThanOrEqual(game_date,1996-03-15)" in text


@pytest.mark.parametrize("name", ["decision_table", "view_U", "view_L1", "pa_history", "pitch_delta"])
def test_one_exchange_by_game(spark, sf, large, name):
    text = plan(CATALOG[name].run(spark, sf))
    moved = [m for m in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text) if "game_pk" in m]
    assert len(moved) == 1


@pytest.mark.parametrize("name", ["matchup_memory", "ablation_delta", "ope_table", "bits_seq",
                                  "permute_history", "view_OM"])
def test_no_cross_join_and_no_python(spark, sf, large, name):
    text = plan(CATALOG[name].run(spark, sf))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython"):
        assert bad not in text


def test_scan_reads_only_what_a_query_needs(spark, sf):
    text = plan(pitch_log(spark, sf).groupBy("game_type").agg(F.count("*")))
    read = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert read and not any("l_quantity" in r or "l_discount" in r for r in read)
