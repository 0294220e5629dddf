from __future__ import annotations

import datetime as dt

import pytest
from fixtures import log, pa
from pyspark.sql import functions as F

from throughline.config import Study
from throughline.operators import decision, history, views
from throughline.operators.decision import ContractError

DAY = dt.date(2021, 5, 1)


def table(spark, rows):
    return decision.decision_table(log(spark, rows))


def test_null_and_unknown_codes_are_other(spark):
    rows = [{"pitch_number": i, "pitch_type": c} for i, c in enumerate([None, "ZZ", "FT", "ST"], 1)]
    got = [r.family for r in table(spark, rows).orderBy("pitch_number").collect()]
    assert got == ["XX", "XX", "SI", "SL"]


def test_base_state_covers_all_patterns(spark):
    rows = [{"pitch_number": i + 1, "on_1b": 5 if i & 1 else None, "on_2b": 5 if i & 2 else None,
             "on_3b": 5 if i & 4 else None} for i in range(8)]
    assert [r.base_state for r in table(spark, rows).orderBy("pitch_number").collect()] == list(range(8))


def test_mid_pa_pitching_change(spark):
    rows = pa(1, ["FF", "FF"]) + [{"at_bat_number": 1, "pitch_number": 3, "pitcher": 11}]
    got = table(spark, rows).orderBy("pitch_number").collect()
    assert [r.pitcher_pitch_count for r in got] == [0, 1, 0]
    assert {r.pa_id for r in got} == {1001}


def test_batter_relative_location(spark):
    rows = [{"pitch_number": 1, "stand": "L"}, {"pitch_number": 2}, {"pitch_number": 3, "sz_top": None}]
    got = table(spark, rows).orderBy("pitch_number").collect()
    assert [r.plate_x_br for r in got] == [-0.5, 0.5, 0.5]
    assert [r.plate_z_norm for r in got] == [0.5, 0.5, None]


def test_key_violations_raise(spark):
    with pytest.raises(ContractError):
        decision.assert_key(log(spark, [{}, {}]))
    with pytest.raises(ContractError):
        decision.assert_key(log(spark, [{"game_pk": None}]))
    with pytest.raises(ContractError):
        decision.assert_key(log(spark, [{"at_bat_number": 1000}]))
    decision.assert_key(log(spark, [{}, {"pitch_number": 2}]))


SIGNS = [
    {"pitch_number": 1, "description": "called_strike", "delta_run_exp": -0.05},
    {"pitch_number": 2, "description": "swinging_strike", "delta_run_exp": -0.06},
    {"pitch_number": 3, "description": "swinging_strike", "events": "strikeout", "delta_run_exp": -0.2},
    {"pitch_number": 4, "description": "hit_into_play", "events": "field_out", "delta_run_exp": -0.2},
    {"pitch_number": 5, "description": "ball", "events": "walk", "delta_run_exp": 0.3},
    {"pitch_number": 6, "description": "hit_into_play", "events": "home_run", "delta_run_exp": 1.4},
]


def test_reward_sign(spark):
    good = table(spark, SIGNS)
    decision.assert_reward_sign(good)
    with pytest.raises(ContractError):
        decision.assert_reward_sign(good.withColumn("reward", -F.col("reward")))


def test_era_guard(spark):
    old = log(spark, [{"game_date": dt.date(2019, 5, 1)}, {"pitch_number": 2}])
    with pytest.raises(ContractError):
        decision.assert_era(old, 2020)
    assert decision.era_filter(old, 2020).count() == 1


def test_two_games_on_one_date_do_not_see_each_other(spark):
    rows = (pa(1, ["FF"] * 3, game_pk=1) + pa(1, ["SL"] * 2, game_pk=2)
            + pa(1, ["CH"], game_pk=3, game_date=DAY + dt.timedelta(1)))
    mix = history.repertoire_mix(table(spark, rows), 365).orderBy("game_date").collect()
    assert [(r.hist_n, r.n_ff, r.n_sl) for r in mix] == [(0, 0, 0), (5, 3, 2)]
    assert mix[1].mix_ff == pytest.approx(0.6)


def test_trailing_window_forgets(spark):
    rows = pa(1, ["FF"]) + pa(1, ["FF"], game_pk=2, game_date=DAY + dt.timedelta(365)) \
        + pa(1, ["FF"], game_pk=3, game_date=DAY + dt.timedelta(366))
    mix = history.repertoire_mix(table(spark, rows), 365).orderBy("game_date").collect()
    assert [r.hist_n for r in mix] == [0, 1, 1]


def test_feasible_needs_count_and_share(spark):
    rows = pa(1, ["FF"] * 97 + ["SL"] * 2)
    rows += pa(1, ["FF"], game_pk=2, game_date=DAY + dt.timedelta(1))
    t = history.feasible_mask(history.repertoire_mix(table(spark, rows), 365), 2, 0.03)
    last = t.orderBy(F.desc("game_date")).first()
    assert last.feasible[0] is True      # FF: 97 of 99
    assert last.feasible[3] is False     # SL: two thrown, under three percent


def test_matchup_buckets_are_strictly_prior(spark):
    kw = {"delta_run_exp": -1.0}
    rows = (pa(1, ["FF", "FF"], game_date=dt.date(2020, 5, 1), **kw)
            + pa(1, ["FF"], game_pk=2, **kw)
            + pa(1, ["FF"], game_pk=3, game_date=DAY + dt.timedelta(1), **kw)
            + pa(4, ["FF"], game_pk=3, game_date=DAY + dt.timedelta(1), **kw))
    got = history.matchup_memory(table(spark, rows)).orderBy("row_id").collect()
    assert [(r.mg_n, r.ms_n, r.mo_n) for r in got] == [
        (0, 0, 0), (0, 0, 0), (0, 0, 2), (0, 1, 2), (1, 1, 2)]
    pooled = history.pooled_matchup(history.matchup_memory(table(spark, rows)), 10.0)
    last = pooled.orderBy(F.desc("row_id")).first()
    assert last.pair_n == 4 and last.pooled_reward == pytest.approx(1.0)


def test_views_same_multiset(spark):
    rows = pa(1, ["FF", "SL", "CH"]) + pa(2, ["SL", "FF", "CH"])
    wide = views.wide_table(table(spark, rows), Study())
    third = F.col("pitch_number") == 3
    u = views.view_U(wide).filter(third).select(*views.UNORDERED).collect()
    o = views.view_O(wide).filter(third).select("history_text").collect()
    assert u[0] == u[1]
    assert {r.history_text for r in o} == {"FF>SL", "SL>FF"}


def test_features_ignore_the_present_and_the_future(spark, sf):
    """Execution and outcome of decision t and later must not move the state at t."""
    from throughline.sources.adapter import pitch_log
    base = pitch_log(spark, sf)
    at = 3
    late = F.col("pitch_number") >= at
    moved = base.withColumns({
        c: F.when(late, F.col(c) + 7).otherwise(F.col(c))
        for c in ("release_speed", "pfx_x", "plate_x", "plate_z")})
    moved = moved.withColumn("description", F.when(late, F.lit("foul")).otherwise(F.col("description")))
    moved = moved.withColumn("pitch_type", F.when(late, F.lit("KN")).otherwise(F.col("pitch_type")))
    cols = ["row_id", *views.UNORDERED, *[c for c in views.ORDERED if not c.startswith("prev_vs")]]
    a, b = (views.ordered(views.unordered(decision.decision_table(x)))
            .filter(F.col("pitch_number") == at).select(*cols) for x in (base, moved))
    assert a.count() > 0
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_leak_guard(spark):
    t = table(spark, [{}])
    with pytest.raises(ContractError):
        decision.assert_no_leakage(t.select("balls", "release_speed"))
    wide = views.wide_table(t, Study())
    for v in views.ALL:
        views.view(wide, v)
    dropped = views.mechanism_ablation(views.view_O(wide), "velocity")
    assert "prev_release_speed" not in dropped.columns and "prev_family" in dropped.columns


def test_episode_return_identity(spark):
    rows = [{"pitch_number": i, "delta_run_exp": d} for i, d in enumerate([0.1, None, -0.3], 1)]
    t = table(spark, rows)
    got = history.episode_return(t).first()
    assert got.g == pytest.approx(0.2) and got.terminal == pytest.approx(0.2)
    history.assert_episode_return(t)


def test_recomputed_reward_telescopes(spark):
    """Over a half-inning the rewards add to the expectancy at its start minus runs scored."""
    rows = [{"pitch_number": i, "balls": i - 1, "post_bat_score": 1 if i == 3 else 0} for i in (1, 2, 3)]
    t = table(spark, rows)
    re = history.run_expectancy_table(t, F.lit(True))
    got = history.recomputed_reward(t, re).agg(F.sum("reward_recomputed").alias("s")).first().s
    assert got == pytest.approx(1.0 - 1.0)


def test_sequence_array_pads_left(spark):
    got = history.sequence_array(table(spark, pa(1, ["FF", "SL", "CH"])), 2).orderBy("row_id").collect()
    assert [r.seq for r in got] == [[0, 0], [0, 1], [1, 4]]
    assert [r.seq_mask for r in got] == [[0, 0], [0, 1], [1, 1]]


def test_chunked_lags_equal_plain_lags(spark, sf):
    """One user holds a third of all events and most of one day: chunks carry over correctly."""
    from pyspark.sql import Window as W

    from throughline.sources.adapter import user_event_log
    base = user_event_log(spark, sf)
    hot = base.withColumns({
        "user_id": F.when(F.col("event_id") % 3 == 0, F.lit(1)).otherwise(F.col("user_id")),
        "day": F.when(F.col("event_id") % 2 == 0, F.lit(0)).otherwise(F.col("day"))})
    hot = hot.withColumn("chunk", (F.col("event_id") / 7).cast("int"))
    w = W.partitionBy("user_id", "day").orderBy("chunk", "event_id")
    want = hot.select("event_id", F.row_number().over(w).alias("seq"),
                      *[F.coalesce(F.lag("event_type", d).over(w), F.lit("^")).alias(n)
                        for d, n in ((1, "prev_family"), (2, "prev2_family"), (3, "prev3_family"))])
    got = history.chunked_lags(hot, ["user_id", "day"], "chunk", ["event_id"], "event_type", 3, "^")
    got = got.select(*want.columns)
    assert want.groupBy().max("seq").first()[0] > 50
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


def test_one_hot_pitcher(spark):
    """A third of all rows from one pitcher and batter: trailing sums stay exact and whole."""
    rows = []
    for g in range(30):
        hot = g % 3 == 0
        rows += pa(1, ["FF", "SL", "FF"], game_pk=g, pitcher=99 if hot else 100 + g,
                   batter=98 if hot else 200 + g, game_date=DAY + dt.timedelta(g), delta_run_exp=-0.1)
    t = table(spark, rows)
    mem = history.matchup_memory(t)
    assert mem.count() == 90
    last = mem.filter("game_pk = 27").first()
    assert last.ms_n == 27 and last.ph_n == 27
    mix = {r.game_date: r.hist_n for r in history.repertoire_mix(t, 365).filter("pitcher = 99").collect()}
    assert mix[DAY + dt.timedelta(27)] == 27
