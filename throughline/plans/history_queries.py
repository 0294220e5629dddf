"""Queries over sections C and D: history operators and state views."""

from __future__ import annotations

from pyspark.sql import functions as F

from throughline.config import FAMILIES
from throughline.operators import history, views
from throughline.plans.common import STUDY, TRAIN, Query, r6, rounded, spread, table
from throughline.plans.oracle import r6 as q6, shares, sql

K = STUDY.shrink
DAYS = STUDY.window_days
LOW = [f.lower() for f in FAMILIES]


def repertoire_mix(spark, path):
    t = history.repertoire_mix(table(spark, path), DAYS)
    return rounded(t.withColumn("game_date", F.col("game_date").cast("string")),
                   *[f"mix_{f}" for f in LOW])


def batter_tend(spark, path):
    t = history.batter_tend(table(spark, path), DAYS)
    return rounded(t.withColumn("game_date", F.col("game_date").cast("string")),
                   "tend_swing", "tend_whiff", "tend_foul", "tend_in_play", "tend_reward")


def feasible_mask(spark, path):
    mix = history.repertoire_mix(table(spark, path), DAYS)
    t = history.feasible_mask(mix, STUDY.min_count, STUDY.min_share)
    return t.select("pitcher", F.col("game_date").cast("string").alias("game_date"),
                    *[F.col("feasible")[i].alias(f"ok_{f}") for i, f in enumerate(LOW)])


def low_history(spark, path):
    from throughline.operators import decision
    df = table(spark, path)
    mix = history.repertoire_mix(df, DAYS).select("pitcher", "game_date", "hist_n")
    t = decision.low_history(df.join(mix, ["pitcher", "game_date"], "left"), STUDY.min_history)
    return t.groupBy("season", "is_low_history").agg(F.count("*").alias("n"))


def family_baseline_diff(spark, path):
    cols = [f"prev_vs_base_{p}" for p in history.PHYSICS]
    t = history.family_baseline_diff(table(spark, path), DAYS)
    return rounded(t.select("row_id", *cols), *cols)


def pa_history(spark, path):
    t = history.pa_history(table(spark, path))
    one = F.transform("history", lambda h: F.concat_ws(
        ":", h["family"], F.coalesce(h["pitch_type"], F.lit("null")), h["outcome"],
        F.round(h["release_speed"] * 2).cast("long").cast("string"),
        h["release_spin_rate"].cast("string")))
    return t.select("row_id", F.size("history").alias("n_prior"),
                    F.array_join(one, ">").alias("history"))


def previous_pitch(spark, path):
    t = history.previous_pitch(table(spark, path), ["family", "outcome", "release_speed"])
    return rounded(t.select("row_id", "prev_family", "prev_outcome", "prev_release_speed"),
                   "prev_release_speed")


EARLIER = 98  # an episode holds fewer than 100 decisions, by the key contract


def sequence_array(spark, path):
    t = history.sequence_array(table(spark, path), EARLIER)
    return t.select("row_id", F.array_join(F.col("seq").cast("array<string>"), ",").alias("seq"),
                    F.array_join(F.col("seq_mask").cast("array<string>"), ",").alias("mask"),
                    r6(F.aggregate("seq_speed", F.lit(0.0), lambda a, x: a + x)).alias("speed_sum"))


MEM = ["mg_pa", "mg_n", "mg_sum", "ms_n", "ms_sum", "mo_n", "mo_sum", "ph_n", "ph_sum"]


def matchup_memory(spark, path):
    t = history.matchup_memory(table(spark, path))
    return rounded(t.select("row_id", *MEM, *[F.col("bf_n")[i].alias(f"bf_n_{f}") for i, f in enumerate(LOW)],
                            *spread("bf_sum", "bf_sum")), "mg_sum", "ms_sum", "mo_sum", "ph_sum")


def pooled_matchup(spark, path):
    t = history.pooled_matchup(history.matchup_memory(table(spark, path)), K)
    return rounded(t.select("row_id", "pair_n", "pooled_reward"), "pooled_reward")


def episode_return(spark, path):
    t = history.episode_return(table(spark, path))
    return rounded(t, "g", "terminal")


def run_expectancy(spark, path):
    return rounded(history.run_expectancy_table(table(spark, path), F.expr(TRAIN)), "run_exp")


def recomputed_reward(spark, path):
    df = table(spark, path)
    t = history.recomputed_reward(df, history.run_expectancy_table(df, F.expr(TRAIN)))
    return rounded(t.select("row_id", "reward_recomputed"), "reward_recomputed")


def _view(name, cols):
    def run(spark, path):
        v = views.view(views.wide_table(table(spark, path), STUDY, (name,)), name)
        doubles = [f.name for f in v.schema.fields if f.dataType.typeName() == "double" and f.name in cols]
        return rounded(v.select("row_id", *cols), *doubles)
    return run


CTX = ["count_state", "base_state", "platoon", "pitcher_pitch_count", "times_thru_order", "hist_n",
       "mix_ff", "mix_xx", "tend_n", "tend_swing", "tend_reward"]
UN = [f"u_{f}" for f in LOW] + ["u_n", "u_speed", "u_plate_x", "u_plate_z", "u_takes", "u_whiffs", "u_fouls"]
LAST = ["prev_family", "prev_outcome", "prev_release_speed", "prev_plate_x_br", "prev_plate_z_norm"]
ORD = LAST + ["prev2_family", "prev3_outcome", "last_d_velo", "last_d_plate",
              "prev_vs_base_release_speed", "history_text"]
OM = ORD + ["mg_pa", "ms_n", "mo_n", "ph_n", "pair_n", "pooled_reward"]

# ---------------------------------------------------------------- SQL side

MIX = f"""mix AS (
  SELECT pitcher, game_date, dayno, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS hist_n,
    {', '.join(f'CAST(coalesce(sum(d_{f}) OVER w, 0) AS BIGINT) AS n_{f}' for f in LOW)}
  FROM (SELECT pitcher, game_date, dayno, count(*) AS n, {shares('d')} FROM dec GROUP BY 1,2,3)
  WINDOW w AS (PARTITION BY pitcher ORDER BY dayno RANGE BETWEEN {DAYS} PRECEDING AND 1 PRECEDING)),
mixed AS (SELECT *, {', '.join(f'n_{f}::DOUBLE/nullif(hist_n,0) AS mix_{f}' for f in LOW)} FROM mix)"""

TEND = f"""tend AS (
  SELECT batter, game_date, tn AS tend_n, sw/nullif(tn,0) AS tend_swing, wh/nullif(sw,0) AS tend_whiff,
    fo/nullif(sw,0) AS tend_foul, ip/nullif(sw,0) AS tend_in_play, rs/nullif(rn,0) AS tend_reward
  FROM (SELECT batter, game_date, CAST(coalesce(sum(n) OVER w,0) AS BIGINT) AS tn,
      coalesce(sum(s) OVER w,0)::DOUBLE AS sw, coalesce(sum(h) OVER w,0)::DOUBLE AS wh,
      coalesce(sum(f) OVER w,0)::DOUBLE AS fo, coalesce(sum(i) OVER w,0)::DOUBLE AS ip,
      coalesce(sum(r) OVER w,0)::DOUBLE AS rs, coalesce(sum(c) OVER w,0)::DOUBLE AS rn
    FROM (SELECT batter, game_date, dayno, count(*) AS n,
        count(*) FILTER (outcome IN ('whiff','foul','in_play')) AS s, count(*) FILTER (outcome='whiff') AS h,
        count(*) FILTER (outcome='foul') AS f, count(*) FILTER (outcome='in_play') AS i,
        coalesce(sum(reward),0) AS r, count(reward) AS c FROM dec GROUP BY 1,2,3)
    WINDOW w AS (PARTITION BY batter ORDER BY dayno RANGE BETWEEN {DAYS} PRECEDING AND 1 PRECEDING)))"""

BASELINE = f"""basel AS (
  SELECT pitcher, family, game_date, {', '.join(f'sum(s{i}) OVER w / nullif(sum(c{i}) OVER w, 0) AS b{i}' for i in range(3))}
  FROM (SELECT pitcher, family, game_date, dayno,
      {', '.join(f'sum({p}) AS s{i}, count({p}) AS c{i}' for i, p in enumerate(history.PHYSICS))}
    FROM dec GROUP BY 1,2,3,4)
  WINDOW w AS (PARTITION BY pitcher, family ORDER BY dayno RANGE BETWEEN {DAYS} PRECEDING AND 1 PRECEDING)),
based AS (
  SELECT row_id, {', '.join(f'lag({p} - b{i}) OVER w AS prev_vs_base_{p}' for i, p in enumerate(history.PHYSICS))}
  FROM dec LEFT JOIN basel USING (pitcher, family, game_date)
  WINDOW w AS (PARTITION BY pa_id ORDER BY pitch_number))"""

MEMORY = f"""pairday AS (SELECT pitcher, batter, season, dayno, game_date, count(reward) AS n, coalesce(sum(reward),0) AS s
  FROM dec GROUP BY ALL),
meet AS (SELECT pitcher, batter, game_date,
    CAST(coalesce(sum(n) OVER ws,0) AS BIGINT) AS ms_n, coalesce(sum(s) OVER ws,0) AS ms_sum,
    CAST(coalesce(sum(n) OVER wo,0) AS BIGINT) AS mo_n, coalesce(sum(s) OVER wo,0) AS mo_sum
  FROM pairday WINDOW ws AS (PARTITION BY pitcher, batter, season ORDER BY dayno RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    wo AS (PARTITION BY pitcher, batter ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bf AS (SELECT batter, game_date, {', '.join(f'CAST(coalesce(sum(c_{f}) OVER w,0) AS BIGINT) AS bf_n_{f}, coalesce(sum(s_{f}) OVER w,0) AS bf_sum_{f}' for f in LOW)}
  FROM (SELECT batter, game_date, dayno, {', '.join(f"count(reward) FILTER (family='{f.upper()}') AS c_{f}, coalesce(sum(reward) FILTER (family='{f.upper()}'),0) AS s_{f}" for f in LOW)}
    FROM dec GROUP BY 1,2,3) WINDOW w AS (PARTITION BY batter ORDER BY dayno RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ph AS (SELECT pitcher, stand, game_date, CAST(coalesce(sum(n) OVER w,0) AS BIGINT) AS ph_n, coalesce(sum(s) OVER w,0) AS ph_sum
  FROM (SELECT pitcher, stand, game_date, dayno, count(reward) AS n, coalesce(sum(reward),0) AS s FROM dec GROUP BY 1,2,3,4)
  WINDOW w AS (PARTITION BY pitcher, stand ORDER BY dayno RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mem AS (SELECT d.*, CAST(dense_rank() OVER (PARTITION BY game_pk, pitcher, batter ORDER BY at_bat_number) - 1 AS INT) AS mg_pa,
    count(reward) OVER wg AS mg_n, coalesce(sum(reward) OVER wg, 0) AS mg_sum,
    ms_n, ms_sum, mo_n, mo_sum, ph_n, ph_sum, {', '.join(f'bf_n_{f}, bf_sum_{f}' for f in LOW)}
  FROM dec d LEFT JOIN meet USING (pitcher, batter, game_date) LEFT JOIN bf USING (batter, game_date)
    LEFT JOIN ph USING (pitcher, stand, game_date)
  WINDOW wg AS (PARTITION BY game_pk, pitcher, batter ORDER BY at_bat_number RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pooled AS (SELECT *, mg_n+ms_n+mo_n AS pair_n,
    (mg_sum+ms_sum+mo_sum + {K}*coalesce((b+p)/2, b, p, 0))/(mg_n+ms_n+mo_n+{K}) AS pooled_reward
  FROM (SELECT *, ({'+'.join(f'bf_sum_{f}' for f in LOW)})/nullif({'+'.join(f'bf_n_{f}' for f in LOW)},0) AS b,
    ph_sum/nullif(ph_n,0) AS p FROM mem))"""

RE = f"""re AS (SELECT base_state, outs_when_up, count_state, count(*) AS n, avg(fut) AS run_exp FROM (
  SELECT *, max(post_bat_score) OVER (PARTITION BY game_pk, inning, inning_topbot) - bat_score AS fut
  FROM dec WHERE {TRAIN}) GROUP BY 1,2,3)"""

HIST = "string_agg(family, '>') OVER p AS history_text"
UNORDERED = f"""{', '.join(f"CAST(coalesce(count(*) FILTER (family='{f.upper()}') OVER p,0) AS BIGINT) AS u_{f}" for f in LOW)},
  count(*) OVER p AS u_n, {q6('avg(release_speed) OVER p')} AS u_speed, {q6('avg(plate_x_br) OVER p')} AS u_plate_x,
  {q6('avg(plate_z_norm) OVER p')} AS u_plate_z,
  count(*) FILTER (outcome IN ('ball','called_strike')) OVER p AS u_takes,
  count(*) FILTER (outcome='whiff') OVER p AS u_whiffs, count(*) FILTER (outcome='foul') OVER p AS u_fouls"""
CONTEXT = f"""ctx AS (SELECT d.*, stand = p_throws AS platoon,
    CAST(row_number() OVER (PARTITION BY game_pk, pitcher ORDER BY at_bat_number, pitch_number) - 1 AS INT) AS pitcher_pitch_count,
    CAST(dense_rank() OVER (PARTITION BY game_pk, pitcher, batter ORDER BY at_bat_number) AS INT) AS times_thru_order,
    hist_n, mix_ff, mix_xx, tend_n, tend_swing, tend_reward
  FROM dec d LEFT JOIN mixed USING (pitcher, game_date) LEFT JOIN tend USING (batter, game_date))"""
CTX_SQL = ("row_id, count_state, base_state, platoon, pitcher_pitch_count, times_thru_order, hist_n, "
           + ", ".join(f"{q6(c)} AS {c}" for c in ("mix_ff", "mix_xx")) + ", tend_n, "
           + ", ".join(f"{q6(c)} AS {c}" for c in ("tend_swing", "tend_reward")))
LAST_SQL = (f"lag(family) OVER o AS prev_family, lag(outcome) OVER o AS prev_outcome, "
            f"{q6('lag(release_speed) OVER o')} AS prev_release_speed, "
            f"{q6('lag(plate_x_br) OVER o')} AS prev_plate_x_br, {q6('lag(plate_z_norm) OVER o')} AS prev_plate_z_norm")
ORD_SQL = f"""{LAST_SQL}, lag(family, 2) OVER o AS prev2_family, lag(outcome, 3) OVER o AS prev3_outcome,
  {q6('lag(release_speed) OVER o - lag(release_speed,2) OVER o')} AS last_d_velo,
  {q6('sqrt(power(lag(plate_x_br) OVER o - lag(plate_x_br,2) OVER o,2)+power(lag(plate_z_norm) OVER o - lag(plate_z_norm,2) OVER o,2))')} AS last_d_plate,
  {q6('prev_vs_base_release_speed')} AS prev_vs_base_release_speed,
  coalesce(string_agg(family, '>') OVER p, '') AS history_text"""
FRAMES = """WINDOW o AS (PARTITION BY pa_id ORDER BY pitch_number),
  p AS (PARTITION BY pa_id ORDER BY pitch_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""

QUERIES = {
    "repertoire_mix": Query(repertoire_mix, sql(
        f"SELECT pitcher, CAST(game_date AS VARCHAR) AS game_date, hist_n, {', '.join('n_' + f for f in LOW)}, "
        f"{', '.join(f'{q6(f'mix_{f}')} AS mix_{f}' for f in LOW)} FROM mixed", MIX)),
    "batter_tend": Query(batter_tend, sql(
        f"SELECT batter, CAST(game_date AS VARCHAR) AS game_date, tend_n, "
        f"{', '.join(f'{q6(c)} AS {c}' for c in ('tend_swing', 'tend_whiff', 'tend_foul', 'tend_in_play', 'tend_reward'))} FROM tend",
        TEND)),
    "feasible_mask": Query(feasible_mask, sql(
        f"SELECT pitcher, CAST(game_date AS VARCHAR) AS game_date, "
        f"{', '.join(f'n_{f} >= {STUDY.min_count} AND coalesce(mix_{f},0) >= {STUDY.min_share} AS ok_{f}' for f in LOW)} FROM mixed",
        MIX)),
    "low_history": Query(low_history, sql(
        f"SELECT season, coalesce(hist_n,0) < {STUDY.min_history} AS is_low_history, count(*) AS n "
        "FROM dec LEFT JOIN mixed USING (pitcher, game_date) GROUP BY 1,2", MIX)),
    "family_baseline_diff": Query(family_baseline_diff, sql(
        f"SELECT row_id, {', '.join(f'{q6(f'prev_vs_base_{p}')} AS prev_vs_base_{p}' for p in history.PHYSICS)} FROM based",
        BASELINE)),
    "pa_history": Query(pa_history, sql("""
SELECT row_id, CAST(count(*) OVER p AS INT) AS n_prior, coalesce(string_agg(family||':'||coalesce(pitch_type,'null')||':'||outcome||':'||
  CAST(round(release_speed*2) AS BIGINT)||':'||release_spin_rate, '>') OVER p, '') AS history
FROM dec WINDOW p AS (PARTITION BY pa_id ORDER BY pitch_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")),
    "previous_pitch": Query(previous_pitch, sql(f"""
SELECT row_id, lag(family) OVER w AS prev_family, lag(outcome) OVER w AS prev_outcome,
  {q6('lag(release_speed) OVER w')} AS prev_release_speed
FROM dec WINDOW w AS (PARTITION BY pa_id ORDER BY pitch_number)""")),
    "sequence_array": Query(sequence_array, sql(f"""
SELECT row_id, {"||','||".join(f"CAST(coalesce(lag(fi,{d}) OVER w,0) AS VARCHAR)" for d in range(EARLIER, 0, -1))} AS seq,
  {"||','||".join(f"(lag(fi,{d}) OVER w IS NOT NULL)::INT::VARCHAR" for d in range(EARLIER, 0, -1))} AS mask,
  {q6('+'.join(f"coalesce(lag(release_speed,{d}) OVER w,0)" for d in range(EARLIER, 0, -1)))} AS speed_sum
FROM (SELECT *, list_position([{','.join(f"'{f}'" for f in FAMILIES)}], family) AS fi FROM dec)
WINDOW w AS (PARTITION BY pa_id ORDER BY pitch_number)""")),
    "matchup_memory": Query(matchup_memory, sql(
        f"SELECT row_id, mg_pa, mg_n, {q6('mg_sum')} AS mg_sum, ms_n, {q6('ms_sum')} AS ms_sum, mo_n, "
        f"{q6('mo_sum')} AS mo_sum, ph_n, {q6('ph_sum')} AS ph_sum, "
        f"{', '.join(f'bf_n_{f}, {q6(f'bf_sum_{f}')} AS bf_sum_{f}' for f in LOW)} FROM mem", MEMORY)),
    "pooled_matchup": Query(pooled_matchup, sql(
        f"SELECT row_id, pair_n, {q6('pooled_reward')} AS pooled_reward FROM pooled", MEMORY)),
    "episode_return": Query(episode_return, sql(
        f"SELECT pa_id, count(*) AS n, {q6('sum(reward)')} AS g, {q6('sum(reward)')} AS terminal FROM dec GROUP BY 1")),
    "run_expectancy": Query(run_expectancy, sql(
        f"SELECT base_state, outs_when_up, count_state, n, {q6('run_exp')} AS run_exp FROM re", RE)),
    "recomputed_reward": Query(recomputed_reward, sql(f"""
SELECT row_id, {q6('-((CASE WHEN lead(1) OVER w IS NULL THEN 0 ELSE lead(run_exp) OVER w END) - run_exp + (post_bat_score - bat_score))')} AS reward_recomputed
FROM dec LEFT JOIN re USING (base_state, outs_when_up, count_state)
WINDOW w AS (PARTITION BY game_pk, inning, inning_topbot ORDER BY at_bat_number, pitch_number)""", RE)),
    "view_C": Query(_view("C", CTX), sql(f"SELECT {CTX_SQL} FROM ctx", MIX, TEND, CONTEXT)),
    "view_U": Query(_view("U", UN), sql(f"SELECT row_id, {UNORDERED} FROM dec {FRAMES}")),
    "view_L1": Query(_view("L1", LAST), sql(f"SELECT row_id, {LAST_SQL} FROM dec {FRAMES}")),
    "view_O": Query(_view("O", ORD), sql(
        f"SELECT row_id, {ORD_SQL} FROM dec JOIN based USING (row_id) {FRAMES}", BASELINE)),
    "view_OM": Query(_view("OM", OM), sql(
        f"SELECT row_id, {ORD_SQL}, mg_pa, ms_n, mo_n, ph_n, pair_n, {q6('pooled_reward')} AS pooled_reward "
        f"FROM pooled JOIN based USING (row_id) {FRAMES}", BASELINE, MEMORY)),
}
