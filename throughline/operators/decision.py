"""The decision table: one row per decision, everything in it known before the decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from throughline.config import (
    EXECUTION_COLUMNS, FAMILIES, OTHER_FAMILY, OUTCOME_COLUMNS, PITCH, SLICES, SWINGS, TAKES,
    Cols, Study,
)
from throughline.functions import scalars


class ContractError(ValueError):
    """The data breaks a rule that every result downstream relies on."""


def key_report(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    """One row: rows, rows with a null in the key, duplicated keys, keys out of range.

    An at-bat number below 1000 and an order below 100 keep the derived ids unique, and
    bound every in-game window to at most 99,900 rows.
    """
    has_null = F.lit(False)
    for k in c.key:
        has_null = has_null | F.col(k).isNull()
    wide = ~(F.col(c.at_bat).between(0, 999) & F.col(c.order).between(0, 99))
    per_key = df.groupBy(*c.key).agg(F.count("*").alias("_n"))
    return per_key.agg(
        F.sum("_n").alias("n_rows"),
        F.coalesce(F.sum(F.when(has_null, F.col("_n"))), F.lit(0)).alias("n_null"),
        F.count_if(F.col("_n") > 1).alias("n_duplicated"),
        F.count_if(wide).alias("n_out_of_range"),
    )


def assert_key(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    got = key_report(df, c).first()
    if got.n_null or got.n_duplicated or got.n_out_of_range:
        raise ContractError(f"natural key {c.key} broken: {got.asDict()}")
    return df


def game_type_filter(df: DataFrame, types=("R",)) -> DataFrame:
    return df.filter(F.col("game_type").isin(*types))


def _derived(c: Cols) -> dict:
    """Every column that follows from the row itself."""
    return {
        c.season: F.year(c.date),
        c.episode: F.col(c.game) * 1000 + F.col(c.at_bat),
        c.row: (F.col(c.game) * 1000 + F.col(c.at_bat)) * 100 + F.col(c.order),
        "is_seq_eligible": F.col(c.order) >= 2,
        "base_state": scalars.base_state(F.col("on_1b"), F.col("on_2b"), F.col("on_3b")),
        "score_diff_pitcher": F.col("fld_score") - F.col("bat_score"),
        "platoon": F.col("stand") == F.col("p_throws"),
        "park": F.col("home_team"),
        "count_state": scalars.count_state(F.col("balls"), F.col("strikes")),
        c.action: scalars.family(F.col("pitch_type")),
        c.outcome: scalars.outcome_token(F.col("description")),
        c.reward: F.lit(0.0) - F.col("delta_run_exp"),
        "plate_x_br": F.when(F.col("stand") == "L", -F.col("plate_x")).otherwise(F.col("plate_x")),
        "plate_z_norm": F.try_divide(F.col("plate_z") - F.col("sz_bot"),
                                     F.col("sz_top") - F.col("sz_bot")),
    }


def _labels(c: Cols) -> dict:
    """Outcome-tree labels; a null says the node was not reached."""
    o = F.col(c.outcome)
    known = o.isin(*TAKES, *SWINGS)
    return {
        "is_take": F.when(known, scalars.is_take(o)),
        "node_swing": F.when(known, o.isin(*SWINGS)),
        "node_called_strike": F.when(o.isin(*TAKES), o == "called_strike"),
        "node_contact": F.when(o.isin(*SWINGS), o),
        "node_in_play": F.when(o == "in_play", F.col("events")),
    }


def _add(df: DataFrame, c: Cols, *names: str) -> DataFrame:
    made = _derived(c)
    return df.withColumns({n: made[n] for n in names})


def season(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    return _add(df, c, c.season)


def era_filter(df: DataFrame, first_season: int, c: Cols = PITCH) -> DataFrame:
    """Only the seasons fit for outcome models."""
    return df.filter(F.year(c.date) >= first_season)


def assert_era(df: DataFrame, first_season: int, c: Cols = PITCH) -> DataFrame:
    oldest = df.agg(F.min(F.year(c.date)).alias("y")).first().y
    if oldest is not None and oldest < first_season:
        raise ContractError(f"season {oldest} is descriptive only; outcome models start at {first_season}")
    return df


def pa_id(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    return _add(df, c, c.episode)


def row_id(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    return _add(df, c, c.row)


def seq_eligible(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    return _add(df, c, "is_seq_eligible")


def base_state(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    return _add(df, c, "base_state")


def score_diff_pitcher(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    return _add(df, c, "score_diff_pitcher")


def platoon(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    return _add(df, c, "platoon")


def park(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    return _add(df, c, "park")


def count_state(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    return _add(df, c, "count_state")


def family(df: DataFrame, codes=None, c: Cols = PITCH) -> DataFrame:
    if codes is None:
        return _add(df, c, c.action)
    return df.withColumn(c.action, scalars.family(F.col("pitch_type"), codes))


def recommendable(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    return df.filter(F.col(c.action) != OTHER_FAMILY)


def action_column(df: DataFrame, kind: str = "family") -> DataFrame:
    """The action under study: the family, or the exact code as a second benchmark."""
    if kind == "family":
        return df.withColumn("action", F.col("family"))
    if kind == "pitch_type":
        return df.withColumn("action", F.coalesce(F.col("pitch_type"), F.lit("null")))
    raise ValueError(f"unknown action kind {kind!r}")


def batter_relative(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    """Plate location mirrored for left-handed batters and scaled to the strike zone."""
    return _add(df, c, "plate_x_br", "plate_z_norm")


def outcome_token(df: DataFrame, tokens=None, c: Cols = PITCH) -> DataFrame:
    if tokens is None:
        return _add(df, c, c.outcome)
    return df.withColumn(c.outcome, scalars.outcome_token(F.col("description"), tokens))


def event_tree_labels(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    return df.withColumns(_labels(c))


def reward(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    """Run value from the actor's side: larger is better, null stays null."""
    return _add(df, c, c.reward)


# Outcome classes with the sign their mean reward must have.
SIGN_CLASSES = {"called_strike": 1, "whiff": 1, "strikeout": 1, "out": 1,
                "walk": -1, "home_run": -1}


def reward_sign(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    """Mean reward per outcome class; a row counts in every class it belongs to."""
    classes = F.array_compact(F.array(
        F.when(F.col(c.outcome).isin("called_strike", "whiff"), F.col(c.outcome)),
        F.when(F.col("events").isin("strikeout", "strikeout_double_play"), F.lit("strikeout")),
        F.when(F.col("events").isin("field_out", "force_out", "grounded_into_double_play",
                                    "double_play", "fielders_choice_out"), F.lit("out")),
        F.when(F.col("events").isin("walk", "home_run"), F.col("events")),
    ))
    return (
        df.filter(F.col(c.reward).isNotNull())
        .select(F.explode(classes).alias("outcome_class"), c.reward)
        .groupBy("outcome_class")
        .agg(F.count("*").alias("n"), F.avg(c.reward).alias("mean_reward"))
    )


def assert_reward_sign(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    wrong = [
        (r.outcome_class, r.mean_reward) for r in reward_sign(df, c).collect()
        if r.mean_reward * SIGN_CLASSES[r.outcome_class] <= 0
    ]
    if wrong:
        raise ContractError(f"reward has the wrong sign for {wrong}")
    return df


def with_slices(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    """One row per report slice the decision belongs to."""
    member = {
        "all": F.lit(True),
        "seq_eligible": F.col(c.order) >= 2,
        "long_pa": F.col(c.order) >= 3,
        "two_strike": F.col("strikes") == 2,
        "three_ball": F.col("balls") == 3,
        "first_pitch": F.col(c.order) == 1,
    }
    names = F.array_compact(F.array(*[F.when(member[s], F.lit(s)) for s in SLICES]))
    return df.withColumn("slice", F.explode(names))


def report_slices(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    return with_slices(df, c).groupBy("slice").agg(
        F.count("*").alias("n"), F.avg(c.reward).alias("mean_reward"))


def split_label(df: DataFrame, study: Study, c: Cols = PITCH) -> DataFrame:
    """`split` from the main split plus one column per rolling replication."""
    def label(s):
        y = F.col(c.season)
        return (F.when(y.isin(*s.train), "train").when(y.isin(*s.val), "val")
                .when(y.isin(*s.test), "test"))

    df = df.withColumn("split", label(study.split))
    for i, rep in enumerate(study.replications, 1):
        df = df.withColumn(f"split_r{i}", label(rep))
    return df


def low_history(df: DataFrame, min_history: int, total: str = "hist_n") -> DataFrame:
    return df.withColumn("is_low_history", F.coalesce(F.col(total), F.lit(0)) < min_history)


def pitch_delta(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    """Contrast of each pitch with the one before it in the episode.

    These compare measured pitches, so for a decision only the previous row's values
    are history; see `history.previous_pitch`.
    """
    w = W.partitionBy(c.game, c.at_bat).orderBy(c.order)

    def step(col):
        return F.col(col) - F.lag(col).over(w)

    def distance(a, b):
        return F.sqrt(step(a) * step(a) + step(b) * step(b))

    return (
        df.withColumn("d_velo", step("release_speed"))
        .withColumn("d_move", distance("pfx_x", "pfx_z"))
        .withColumn("d_release", distance("release_pos_x", "release_pos_z"))
        .withColumn("d_plate", distance("plate_x_br", "plate_z_norm"))
    )


def decision_table(log: DataFrame, c: Cols = PITCH) -> DataFrame:
    """Every derived column, next to the raw log. Unused columns are pruned by the plan."""
    w_actor = W.partitionBy(c.game, c.actor).orderBy(c.at_bat, c.order)
    w_pair = W.partitionBy(c.game, c.actor, c.opponent).orderBy(c.at_bat)
    return log.withColumns(_derived(c)).withColumns({
        **_labels(c),
        "pitcher_pitch_count": F.row_number().over(w_actor) - 1,
        "times_thru_order": F.dense_rank().over(w_pair),
    })


# Column names that hold a decision's own execution, outcome or reward.
FORBIDDEN = frozenset(EXECUTION_COLUMNS + OUTCOME_COLUMNS)


def assert_no_leakage(view: DataFrame, forbidden=FORBIDDEN) -> DataFrame:
    found = sorted(set(view.columns) & set(forbidden))
    if found:
        raise ContractError(f"state view holds columns measured at or after the decision: {found}")
    return view


