from __future__ import annotations

import datetime as dt

import pytest
from fixtures import SCHEMA, log, pa
from pyspark.sql import functions as F

from throughline.operators import decision
from throughline.session import scratch
from throughline.sources import landing, profile, schema
from throughline.streaming.landing import land_new_files


def two_seasons(spark):
    return log(spark, pa(1, ["FF", "SL"], game_date=dt.date(2021, 5, 1))
               + pa(1, ["FF"], game_pk=2, game_date=dt.date(2022, 5, 1)))


def test_schema_is_complete():
    assert schema.SOURCE_COLUMNS == 119
    names = schema.TEXT + schema.REAL + schema.WIDE_INT + schema.SMALL_INT + schema.EMPTY
    assert len(set(names)) == 119
    assert set(schema.REQUIRED) <= set(schema.PITCH_LOG.names) and len(schema.REQUIRED) == 25


def test_season_files_with_drifting_types_stack(spark):
    a, b = scratch(spark, "raw"), scratch(spark, "raw")
    one = two_seasons(spark)
    one.write.parquet(a)
    one.withColumn("balls", F.col("balls").cast("double")).withColumn(
        "game_date", F.col("game_date").cast("string")).drop("sz_top").write.parquet(b)
    both = landing.load_log(spark, [a, b])
    assert both.count() == 6
    assert dict(both.dtypes)["balls"] == "int" and dict(both.dtypes)["game_date"] == "date"
    assert both.filter("sz_top IS NULL").count() == 3
    by_glob = landing.load_log(spark, a + "/*.parquet")
    assert by_glob.count() == 3 and by_glob.columns == landing.conform(one).columns
    with pytest.raises(FileNotFoundError):
        landing.load_log(spark, [])


def test_landing_is_resumable(spark):
    root = scratch(spark, "landed")
    df = two_seasons(spark)
    assert landing.land_season(df, root, 2021) is True
    assert landing.land_season(df, root, 2021) is False
    assert landing.land_season(df, root, 2022) is True
    back = landing.load_landed(spark, root)
    assert back.count() == 3
    changed = decision.season(df).withColumn("pitch_type", F.lit("KN"))
    landing.land_log(changed, root)  # both seasons are there: nothing may change
    assert landing.load_landed(spark, root).filter("pitch_type = 'KN'").count() == 0
    summary = {r.season: r for r in landing.landing_summary(spark, root, [2021, 2023]).collect()}
    assert summary[2023].rows == 0
    assert summary[2021].rows == 2 and summary[None].rows == 3 and summary[None].bytes > 0


def test_combined_table_overwrites_only_its_seasons(spark):
    root = scratch(spark, "combined")
    df = two_seasons(spark)
    landing.combined_table(df, root)
    only = df.filter(F.year("game_date") == 2022).withColumn("pitch_type", F.lit("KN"))
    got = landing.combined_table(only, root)
    assert got.count() == 3 and got.filter("pitch_type = 'KN'").count() == 1


def test_required_fields(spark):
    df = two_seasons(spark)
    assert landing.check_required(df) == []
    with pytest.raises(landing.MissingFields):
        landing.check_required(df.drop("balls"))
    assert landing.check_required(df.drop("balls"), strict=False) == ["balls"]


def test_season_window(spark):
    days = [dt.date(2021, 3, 14), dt.date(2021, 3, 15), dt.date(2021, 11, 30), dt.date(2021, 12, 1)]
    df = log(spark, [{"game_pk": i, "game_date": d} for i, d in enumerate(days)])
    assert landing.season_window(df, 2021, 2021).count() == 2


def test_profile(spark):
    df = log(spark, [{"pitch_number": i, "pitch_type": c} for i, c in enumerate(["FF", None, "FF", "SL"], 1)])
    for approximate in (False, True):
        got = {r["column"]: r for r in profile.profile_columns(df, approximate).collect()}
        assert got["pitch_type"].pct_null == pytest.approx(0.25)
        assert got["pitch_type"].n_unique == 2 and got["on_1b"].pct_null == 1.0
    top = profile.top_k_by_count(df, "pitch_type", 1).collect()
    assert [(r.pitch_type, r.n) for r in top] == [("FF", 2)]


def test_stream_lands_each_file_once(spark):
    incoming, root, mark = (scratch(spark, x) for x in ("incoming", "stream", "mark"))
    df = two_seasons(spark)
    df.filter(F.year("game_date") == 2021).coalesce(1).write.parquet(incoming)
    land_new_files(spark, incoming, root, mark, SCHEMA)
    land_new_files(spark, incoming, root, mark, SCHEMA)
    assert spark.read.parquet(root).count() == 2
    df.filter(F.year("game_date") == 2022).coalesce(1).write.mode("append").parquet(incoming)
    land_new_files(spark, incoming, root, mark, SCHEMA)
    got = spark.read.parquet(root)
    assert got.count() == 3 and got.select("season").distinct().count() == 2
