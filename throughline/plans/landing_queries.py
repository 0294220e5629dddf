"""Queries over section A and B of the inventory: profile, decision table, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from throughline.operators import decision
from throughline.plans.common import STUDY, Query, r6, rounded, table
from throughline.plans.oracle import r6 as q6, sql
from throughline.session import scratch
from throughline.sources import landing, profile
from throughline.sources.adapter import pitch_log

#: All columns of the adapter by type.
BY_TYPE = {
    "bigint": "game_pk pitcher batter on_1b on_2b on_3b release_spin_rate",
    "date": "game_date",
    "int": "at_bat_number pitch_number balls strikes outs_when_up inning bat_score fld_score post_bat_score launch_angle",
    "string": "game_type stand p_throws inning_topbot home_team pitch_type pitch_name description type events",
    "double": "release_speed pfx_x pfx_z plate_x plate_z sz_top sz_bot release_extension release_pos_x release_pos_y "
              "release_pos_z launch_speed estimated_woba_using_speedangle delta_run_exp",
}
PROFILED = {c: t for t, names in BY_TYPE.items() for c in names.split()}
SHARED = ["delta_run_exp", "pitch_type", "events"]


def populated_share(spark, path):
    return rounded(profile.populated_share(pitch_log(spark, path), SHARED), "populated")


def profile_columns(spark, path):
    return rounded(profile.profile_columns(pitch_log(spark, path)), "pct_null")


def count_by(spark, path):
    return profile.count_by(pitch_log(spark, path), ["game_type"])


def top_k_by_count(spark, path):
    return profile.top_k_by_count(pitch_log(spark, path), "pitch_type", 10)


def season_count(spark, path):
    return profile.season_count(pitch_log(spark, path))


def check_required(spark, path):
    log = pitch_log(spark, path)
    present = landing.required_report(log)
    counted = log.agg(F.count("*").alias("n_rows"))
    return counted.select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(p).alias("present"))
                            for f, p in present])).alias("r"), "n_rows"
    ).select("r.field", "r.present", "n_rows")


def season_window(spark, path):
    log = landing.season_window(pitch_log(spark, path), 1995, 2001, "03-15", "11-30")
    return decision.season(log).groupBy("season").agg(F.count("*").alias("n_rows"))


def landed_seasons(spark, path):
    """Land the log by season, read it back, count it."""
    root = scratch(spark, "landed")
    log = decision.season(pitch_log(spark, path))
    landing.land_log(log, root)
    return (
        landing.load_landed(spark, root).groupBy("season")
        .agg(F.count("*").alias("n_rows"), F.count_distinct("game_pk").alias("n_games"),
             r6(F.sum("delta_run_exp")).alias("sum_dre"))
    )


def landing_summary(spark, path):
    """Rows and columns per landed season and in total; every season's files hold bytes."""
    root = scratch(spark, "landed")
    landing.combined_table(pitch_log(spark, path), root)
    t = landing.landing_summary(spark, root)
    return t.select("season", "rows", "cols", (F.col("bytes") > 0).alias("has_bytes"))


def assert_key(spark, path):
    return decision.key_report(pitch_log(spark, path))


DECISION = ["row_id", "pa_id", "season", "family", "outcome", "reward", "count_state", "base_state",
            "is_seq_eligible", "score_diff_pitcher", "platoon", "park", "plate_x_br",
            "plate_z_norm", "pitcher_pitch_count", "times_thru_order", "balls", "strikes",
            "outs_when_up", "inning", "inning_topbot", "stand", "p_throws"]


def decision_table(spark, path):
    return rounded(table(spark, path).select(*DECISION), "reward", "plate_x_br", "plate_z_norm")


def outcome_labels(spark, path):
    flags = ["is_take", "node_swing", "node_called_strike"]
    return table(spark, path).select(
        "row_id", "outcome", *[F.col(f).cast("int").alias(f) for f in flags], "node_contact",
        "node_in_play")


def reward_sign(spark, path):
    return rounded(decision.reward_sign(table(spark, path)), "mean_reward")


def report_slices(spark, path):
    return rounded(decision.report_slices(table(spark, path)), "mean_reward")


def split_label(spark, path):
    return (decision.split_label(table(spark, path), STUDY)
            .groupBy("season", "split", "split_r1", "split_r2").agg(F.count("*").alias("n_rows")))


def pitch_delta(spark, path):
    df = decision.pitch_delta(table(spark, path))
    cols = ["d_velo", "d_move", "d_release", "d_plate"]
    return rounded(df.select("row_id", *cols), *cols)


def action_counts(spark, path):
    """Both alphabets, over the seasons open to outcome models and the recommendable actions."""
    df = decision.recommendable(decision.era_filter(table(spark, path), 1997))
    df = decision.game_type_filter(df)
    parts = [decision.action_column(df, k).groupBy("action")
             .agg(F.count("*").alias("n")).withColumn("kind", F.lit(k))
             for k in ("family", "pitch_type")]
    return parts[0].unionByName(parts[1])


_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, {q6(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)')} AS pct_null, "
    f"count(DISTINCT {c}) AS n_unique FROM log" for c, t in PROFILED.items())

QUERIES = {
    "populated_share": Query(populated_share, sql(" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {q6(f'avg(({c} IS NOT NULL)::INT)')} AS populated FROM log"
        for c in SHARED))),
    "profile_columns": Query(profile_columns, sql(_PROFILE_SQL)),
    "count_by": Query(count_by, sql("SELECT game_type, count(*) AS n FROM log GROUP BY 1")),
    "top_k_by_count": Query(top_k_by_count, sql(
        "SELECT pitch_type, count(*) AS n FROM log WHERE pitch_type IS NOT NULL GROUP BY 1 "
        "ORDER BY n DESC, pitch_type LIMIT 10")),
    "season_count": Query(season_count, sql(
        "SELECT count(*) AS n_rows, count(DISTINCT year(game_date)) AS n_seasons FROM log")),
    "check_required": Query(check_required, sql(
        "SELECT unnest([" + ",".join(f"'{f}'" for f in landing.REQUIRED) + "]) AS field, true AS present, "
        "(SELECT count(*) FROM log) AS n_rows")),
    "season_window": Query(season_window, sql(
        "SELECT season, count(*) AS n_rows FROM dec WHERE strftime(game_date, '%m-%d') BETWEEN '03-15' AND '11-30' GROUP BY 1")),
    "landed_seasons": Query(landed_seasons, sql(
        f"SELECT season, count(*) AS n_rows, count(DISTINCT game_pk) AS n_games, "
        f"{q6('sum(delta_run_exp)')} AS sum_dre FROM dec GROUP BY 1")),
    "landing_summary": Query(landing_summary, sql(
        "SELECT season, count(*) AS \"rows\", CAST(43 AS INT) AS cols, true AS has_bytes FROM dec GROUP BY ROLLUP (season)")),
    "assert_key": Query(assert_key, sql("""
SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_null,
  count(*) FILTER (n > 1) AS n_duplicated,
  count(*) FILTER (NOT (at_bat_number BETWEEN 0 AND 999 AND pitch_number BETWEEN 0 AND 99)) AS n_out_of_range
FROM (SELECT game_pk, at_bat_number, pitch_number, count(*) AS n FROM log GROUP BY ALL)""")),
    "decision_table": Query(decision_table, sql(f"""
SELECT row_id, pa_id, season, family, outcome, {q6('reward')} AS reward, count_state, base_state,
  pitch_number >= 2 AS is_seq_eligible, fld_score - bat_score AS score_diff_pitcher,
  stand = p_throws AS platoon, home_team AS park, {q6('plate_x_br')} AS plate_x_br,
  {q6('plate_z_norm')} AS plate_z_norm,
  CAST(count(*) OVER (PARTITION BY game_pk, pitcher ORDER BY at_bat_number, pitch_number ROWS UNBOUNDED PRECEDING) - 1 AS INT) AS pitcher_pitch_count,
  CAST(dense_rank() OVER (PARTITION BY game_pk, pitcher, batter ORDER BY at_bat_number) AS INT) AS times_thru_order,
  balls, strikes, outs_when_up, inning, inning_topbot, stand, p_throws
FROM dec""")),
    "outcome_labels": Query(outcome_labels, sql("""
SELECT row_id, outcome,
  CASE WHEN outcome <> 'other' THEN (outcome IN ('ball','called_strike'))::INT END AS is_take,
  CASE WHEN outcome <> 'other' THEN (outcome IN ('whiff','foul','in_play'))::INT END AS node_swing,
  CASE WHEN outcome IN ('ball','called_strike') THEN (outcome = 'called_strike')::INT END AS node_called_strike,
  CASE WHEN outcome IN ('whiff','foul','in_play') THEN outcome END AS node_contact,
  CASE WHEN outcome = 'in_play' THEN events END AS node_in_play
FROM dec""")),
    "reward_sign": Query(reward_sign, sql(f"""
SELECT outcome_class, count(*) AS n, {q6('avg(reward)')} AS mean_reward FROM (
  SELECT outcome AS outcome_class, reward FROM dec WHERE outcome IN ('called_strike','whiff')
  UNION ALL SELECT 'strikeout', reward FROM dec WHERE events = 'strikeout'
  UNION ALL SELECT 'out', reward FROM dec WHERE events = 'field_out'
  UNION ALL SELECT events, reward FROM dec WHERE events IN ('walk','home_run'))
WHERE reward IS NOT NULL GROUP BY 1""")),
    "report_slices": Query(report_slices, sql(" UNION ALL ".join(
        f"SELECT '{s}' AS slice, count(*) AS n, {q6('avg(reward)')} AS mean_reward FROM dec WHERE {w}"
        for s, w in [("all", "true"), ("seq_eligible", "pitch_number>=2"), ("long_pa", "pitch_number>=3"),
                     ("two_strike", "strikes=2"), ("three_ball", "balls=3"),
                     ("first_pitch", "pitch_number=1")]))),
    "split_label": Query(split_label, sql("""
SELECT season, CASE WHEN season<=1999 THEN 'train' WHEN season=2000 THEN 'val' ELSE 'test' END AS split,
  CASE WHEN season<=1998 THEN 'train' WHEN season=1999 THEN 'val' WHEN season=2000 THEN 'test' END AS split_r1,
  CASE WHEN season<=1999 THEN 'train' WHEN season=2000 THEN 'val' ELSE 'test' END AS split_r2,
  count(*) AS n_rows FROM dec GROUP BY ALL""")),
    "pitch_delta": Query(pitch_delta, sql(f"""
SELECT row_id, {q6('release_speed - lag(release_speed) OVER w')} AS d_velo,
  {q6('sqrt(power(pfx_x - lag(pfx_x) OVER w, 2) + power(pfx_z - lag(pfx_z) OVER w, 2))')} AS d_move,
  {q6('sqrt(power(release_pos_x - lag(release_pos_x) OVER w, 2) + power(release_pos_z - lag(release_pos_z) OVER w, 2))')} AS d_release,
  {q6('sqrt(power(plate_x_br - lag(plate_x_br) OVER w, 2) + power(plate_z_norm - lag(plate_z_norm) OVER w, 2))')} AS d_plate
FROM dec WINDOW w AS (PARTITION BY pa_id ORDER BY pitch_number)""")),
    "action_counts": Query(action_counts, sql("""
SELECT family AS action, count(*) AS n, 'family' AS kind FROM dec
WHERE season>=1997 AND family<>'XX' AND game_type='R' GROUP BY 1
UNION ALL
SELECT coalesce(pitch_type,'null'), count(*), 'pitch_type' FROM dec
WHERE season>=1997 AND family<>'XX' AND game_type='R' GROUP BY 1""")),
}

