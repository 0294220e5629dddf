"""Small literal pitch logs with hand-worked answers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

COLUMNS = {
    "game_pk": (T.LongType(), 1), "game_date": (T.DateType(), dt.date(2021, 5, 1)),
    "game_type": (T.StringType(), "R"), "at_bat_number": (T.IntegerType(), 1),
    "pitch_number": (T.IntegerType(), 1), "pitcher": (T.LongType(), 10),
    "batter": (T.LongType(), 20), "stand": (T.StringType(), "R"), "p_throws": (T.StringType(), "R"),
    "balls": (T.IntegerType(), 0), "strikes": (T.IntegerType(), 0),
    "outs_when_up": (T.IntegerType(), 0), "on_1b": (T.LongType(), None), "on_2b": (T.LongType(), None),
    "on_3b": (T.LongType(), None), "inning": (T.IntegerType(), 1),
    "inning_topbot": (T.StringType(), "Top"), "bat_score": (T.IntegerType(), 0),
    "fld_score": (T.IntegerType(), 0), "post_bat_score": (T.IntegerType(), 0),
    "home_team": (T.StringType(), "T1"), "pitch_type": (T.StringType(), "FF"),
    "pitch_name": (T.StringType(), "FF"), "description": (T.StringType(), "ball"),
    "type": (T.StringType(), "B"), "events": (T.StringType(), None),
    "release_speed": (T.DoubleType(), 90.0), "pfx_x": (T.DoubleType(), 0.0),
    "pfx_z": (T.DoubleType(), 1.0), "plate_x": (T.DoubleType(), 0.5),
    "plate_z": (T.DoubleType(), 2.5), "sz_top": (T.DoubleType(), 3.5),
    "sz_bot": (T.DoubleType(), 1.5), "release_spin_rate": (T.LongType(), 2200),
    "release_extension": (T.DoubleType(), 6.0), "release_pos_x": (T.DoubleType(), -1.0),
    "release_pos_y": (T.DoubleType(), 54.0), "release_pos_z": (T.DoubleType(), 6.0),
    "launch_speed": (T.DoubleType(), None), "launch_angle": (T.IntegerType(), None),
    "estimated_woba_using_speedangle": (T.DoubleType(), None),
    "delta_run_exp": (T.DoubleType(), 0.0),
}
SCHEMA = T.StructType([T.StructField(n, t) for n, (t, _) in COLUMNS.items()])


def log(spark, rows: list[dict]):
    """A pitch log; what a row does not name takes a plain default."""
    data = [tuple(r.get(n, d) for n, (_, d) in COLUMNS.items()) for r in rows]
    return spark.createDataFrame(data, SCHEMA)


def pa(at_bat: int, codes: list[str], **kw) -> list[dict]:
    """One plate appearance of the given pitch codes."""
    return [{"at_bat_number": at_bat, "pitch_number": i, "pitch_type": c, **kw}
            for i, c in enumerate(codes, 1)]
