"""Five nested views of the state. Their differences measure what order is worth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window as W, functions as F

from throughline.config import FAMILIES, PITCH, Cols, Study
from throughline.operators import decision, history

KEYS = ["row_id", "pa_id", "game_pk", "game_date", "season", "at_bat_number", "pitch_number",
        "pitcher", "batter", "is_seq_eligible"]
CONTEXT = (
    ["balls", "strikes", "count_state", "outs_when_up", "base_state", "inning", "inning_topbot",
     "score_diff_pitcher", "stand", "p_throws", "platoon", "pitcher_pitch_count",
     "times_thru_order", "park", "hist_n", "tend_n", "tend_swing", "tend_whiff", "tend_foul",
     "tend_in_play", "tend_reward"]
    + [f"mix_{f.lower()}" for f in FAMILIES]
)
UNORDERED = [f"u_{f.lower()}" for f in FAMILIES] + [
    "u_n", "u_speed", "u_plate_x", "u_plate_z", "u_takes", "u_whiffs", "u_fouls"]
LAST = ["prev_family", "prev_pitch_type", "prev_outcome", "prev_release_speed", "prev_pfx_x",
        "prev_pfx_z", "prev_plate_x_br", "prev_plate_z_norm", "prev_release_spin_rate",
        "prev_release_extension"]
ORDERED = LAST + ["prev2_family", "prev2_outcome", "prev2_release_speed", "prev3_family",
                  "prev3_outcome", "prev3_release_speed", "last_d_velo", "last_d_move",
                  "last_d_release", "last_d_plate", "prev_vs_base_release_speed",
                  "prev_vs_base_pfx_x", "prev_vs_base_pfx_z", "history_text"]
MEMORY = ["mg_pa", "mg_n", "mg_sum", "ms_n", "ms_sum", "mo_n", "mo_sum", "ph_n", "ph_sum",
          "bf_n", "bf_sum", "pair_n", "pooled_reward"]

# What a mechanism ablation removes.
MECHANISMS = {
    "type": ["prev_family", "prev_pitch_type", "prev2_family", "prev3_family", "history_text"]
            + [f"u_{f.lower()}" for f in FAMILIES],
    "location": ["prev_plate_x_br", "prev_plate_z_norm", "last_d_plate", "u_plate_x", "u_plate_z"],
    "velocity": ["prev_release_speed", "prev2_release_speed", "prev3_release_speed", "u_speed",
                 "last_d_velo", "prev_vs_base_release_speed"],
    "release": ["last_d_release", "prev_release_extension"],
    "outcome": ["prev_outcome", "prev2_outcome", "prev3_outcome", "u_takes", "u_whiffs",
                "u_fouls"],
}


def unordered(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    """Counts and means of the episode's earlier decisions; their order cannot show."""
    w = W.partitionBy(c.game, c.at_bat).orderBy(c.order).rowsBetween(W.unboundedPreceding, -1)

    def number(cond):
        return F.coalesce(F.sum(cond.cast("int")).over(w), F.lit(0))

    counts = {f"u_{f.lower()}": number(F.col(c.action) == f) for f in FAMILIES}
    return df.withColumns({
        **counts,
        "u_n": F.count("*").over(w),
        "u_speed": F.avg("release_speed").over(w),
        "u_plate_x": F.avg("plate_x_br").over(w),
        "u_plate_z": F.avg("plate_z_norm").over(w),
        "u_takes": number(F.col(c.outcome).isin("ball", "called_strike")),
        "u_whiffs": number(F.col(c.outcome) == "whiff"),
        "u_fouls": number(F.col(c.outcome) == "foul"),
    })


def ordered(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    """Lags, contrasts of the last two decisions, and the whole order as text."""
    w = W.partitionBy(c.game, c.at_bat).orderBy(c.order)
    df = history.previous_pitch(df, c=c)
    df = history.previous_pitch(df, ["family", "outcome", "release_speed"], depth=3, c=c)
    df = decision.pitch_delta(df, c)
    df = df.withColumns({f"last_{d}": F.lag(d).over(w)
                         for d in ("d_velo", "d_move", "d_release", "d_plate")})
    df = df.drop("d_velo", "d_move", "d_release", "d_plate")
    text = F.array_join(F.transform("history", lambda t: t[c.action]), ">")
    df = history.pa_history(df, [c.action], c).withColumn("history_text", text).drop("history")
    return history.previous_physics(df, c)


ALL = ("C", "U", "L1", "O", "OM")


def wide_table(decisions: DataFrame, study: Study, names=ALL, c: Cols = PITCH) -> DataFrame:
    """The columns of the named views next to the labels; a view is a projection of it.

    All in-game windows come first and share the log's one exchange by game. The joins with
    entity-day tables follow; those tables derive from the plain decisions.
    """
    return across_games(in_game(decisions, names, c), decisions, study, names, c)


def in_game(decisions: DataFrame, names=ALL, c: Cols = PITCH) -> DataFrame:
    """The columns of the named views that come from the same game."""
    df = decisions
    if "U" in names:
        df = unordered(df, c)
    if "O" in names or "OM" in names:
        df = ordered(df, c)
    elif "L1" in names:
        df = history.previous_pitch(df, c=c)
    return history.matchup_game(df, c) if "OM" in names else df


def across_games(df: DataFrame, source: DataFrame, study: Study, names=ALL, c: Cols = PITCH,
                 side: Callable[[DataFrame], DataFrame] = history.as_is) -> DataFrame:
    """Rows of `in_game` with the columns that come from other games, taken from `source`; `side` readies a table for its join."""
    if "OM" in names:
        df = history.pooled_matchup(history.with_meetings(df, source, c, side), study.shrink)
    if "O" in names or "OM" in names:
        df = history.with_baseline(df, source, study.window_days, c, side)
    return history.with_rolling(df, source, study.window_days, c, side)


_COLUMNS = {
    "C": CONTEXT,
    "U": CONTEXT + UNORDERED,
    "L1": CONTEXT + LAST,
    "O": CONTEXT + ORDERED,
    "OM": CONTEXT + ORDERED + MEMORY,
}


def view(wide: DataFrame, name: str) -> DataFrame:
    """One view of `wide_table`, checked for columns a decision cannot know."""
    return decision.assert_no_leakage(wide.select(*KEYS, *_COLUMNS[name]))


def view_C(wide: DataFrame) -> DataFrame:
    return view(wide, "C")


def view_U(wide: DataFrame) -> DataFrame:
    return view(wide, "U")


def view_L1(wide: DataFrame) -> DataFrame:
    return view(wide, "L1")


def view_O(wide: DataFrame) -> DataFrame:
    return view(wide, "O")


def view_OM(wide: DataFrame) -> DataFrame:
    return view(wide, "OM")


def mechanism_ablation(v: DataFrame, group: str) -> DataFrame:
    """The view without one kind of history."""
    return v.drop(*MECHANISMS[group])
