"""What was known before each decision: trailing rates, the episode so far, earlier meetings.

Two frames keep the future out. Inside an episode or game, rows or at-bats strictly before
the current one. Across games, days strictly before the current date, so two games on one
date never see each other. Cross-game history is always summed to entity and day first: the
shuffle carries one row per entity and day, and a trailing window holds at most one row per
day however many decisions a single entity made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from throughline.config import FAMILIES, PITCH, SWINGS, Cols
from throughline.session import small_side


def as_is(df: DataFrame) -> DataFrame:
    return df


def _flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0).cast("long")


def trailing(df: DataFrame, keys: list[str], sums: dict[str, Column], days: int | None,
             c: Cols = PITCH) -> DataFrame:
    """Sums over the `days` before each date an entity appears on (all earlier days if None)."""
    daily = df.groupBy(*keys, c.date).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    start = W.unboundedPreceding if days is None else -days
    w = W.partitionBy(*keys).orderBy(F.unix_date(c.date)).rangeBetween(start, -1)
    return daily.select(*keys, c.date,
                        *[F.coalesce(F.sum(k).over(w), F.lit(0)).alias(k) for k in sums])


def pitcher_pitch_count(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    w = W.partitionBy(c.game, c.actor).orderBy(c.at_bat, c.order)
    return df.withColumn("pitcher_pitch_count", F.row_number().over(w) - 1)


def times_thru_order(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    w = W.partitionBy(c.game, c.actor, c.opponent).orderBy(c.at_bat)
    return df.withColumn("times_thru_order", F.dense_rank().over(w))


def repertoire_mix(df: DataFrame, days: int, c: Cols = PITCH, alphabet=FAMILIES) -> DataFrame:
    """Per actor and date: `hist_n`, a count and a share per action over the trailing window."""
    sums = {f"n_{a.lower()}": _flag(F.col(c.action) == a) for a in alphabet}
    t = trailing(df, [c.actor], {"hist_n": F.lit(1).cast("long"), **sums}, days, c)
    return t.withColumns({f"mix_{a.lower()}": F.try_divide(f"n_{a.lower()}", "hist_n")
                          for a in alphabet})


def batter_tend(df: DataFrame, days: int, c: Cols = PITCH) -> DataFrame:
    """Per opponent and date: trailing response rates and mean reward conceded."""
    o = F.col(c.outcome)
    t = trailing(df, [c.opponent], {
        "tend_n": F.lit(1).cast("long"), "_swing": _flag(o.isin(*SWINGS)),
        "_whiff": _flag(o == "whiff"), "_foul": _flag(o == "foul"),
        "_in_play": _flag(o == "in_play"), "_rewarded": _flag(F.col(c.reward).isNotNull()),
        "_reward": F.coalesce(F.col(c.reward), F.lit(0.0)),
    }, days, c)
    return t.select(
        c.opponent, c.date, "tend_n",
        F.try_divide("_swing", "tend_n").alias("tend_swing"),
        F.try_divide("_whiff", "_swing").alias("tend_whiff"),
        F.try_divide("_foul", "_swing").alias("tend_foul"),
        F.try_divide("_in_play", "_swing").alias("tend_in_play"),
        F.try_divide("_reward", "_rewarded").alias("tend_reward"),
    )


def feasible_mask(mix: DataFrame, min_count: int, min_share: float,
                  alphabet=FAMILIES) -> DataFrame:
    """Which actions the actor used often enough, and as a large enough share, before today."""
    flags = [
        (F.col(f"n_{a.lower()}") >= min_count)
        & (F.coalesce(F.col(f"mix_{a.lower()}"), F.lit(0.0)) >= min_share)
        for a in alphabet
    ]
    return mix.withColumn("feasible", F.array(*flags))


def with_rolling(df: DataFrame, source: DataFrame, days: int, c: Cols = PITCH,
                 side: Callable[[DataFrame], DataFrame] = as_is) -> DataFrame:
    """Join an actor's mix and an opponent's tendencies, taken from `source`, as of the date."""
    return (
        df.join(side(repertoire_mix(source, days, c)), [c.actor, c.date], "left")
        .join(side(batter_tend(source, days, c)), [c.opponent, c.date], "left")
    )


PHYSICS = ["release_speed", "pfx_x", "pfx_z"]


def previous_physics(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    """The lags `with_baseline` needs; a window of the game's exchange like all in-game ones."""
    w = W.partitionBy(c.game, c.at_bat).orderBy(c.order)
    return df.withColumns({
        "_prev_actor": F.coalesce(F.lag(c.actor).over(w), F.col(c.actor)),
        "_prev_action": F.lag(c.action).over(w),
        **{f"_prev_{p}": F.lag(p).over(w) for p in PHYSICS},
    })


def with_baseline(df: DataFrame, source: DataFrame, days: int, c: Cols = PITCH,
                  side: Callable[[DataFrame], DataFrame] = as_is) -> DataFrame:
    """Join the trailing mean of the previous decision's actor and action, taken from `source`."""
    sums = {}
    for p in PHYSICS:
        sums[f"_n_{p}"] = _flag(F.col(p).isNotNull())
        sums[f"_s_{p}"] = F.coalesce(F.col(p), F.lit(0.0))
    base = trailing(source, [c.actor, c.action], sums, days, c)
    base = base.select(
        F.col(c.actor).alias("_prev_actor"), F.col(c.action).alias("_prev_action"), c.date,
        *[F.try_divide(f"_s_{p}", f"_n_{p}").alias(f"_base_{p}") for p in PHYSICS])
    joined = df.join(side(base), ["_prev_actor", "_prev_action", c.date], "left")
    return joined.withColumns({
        f"prev_vs_base_{p}": F.col(f"_prev_{p}") - F.col(f"_base_{p}") for p in PHYSICS
    }).drop("_prev_actor", "_prev_action",
            *[f"_base_{p}" for p in PHYSICS], *[f"_prev_{p}" for p in PHYSICS])


def family_baseline_diff(df: DataFrame, days: int, c: Cols = PITCH) -> DataFrame:
    """Previous decision's speed and movement minus its actor's trailing mean for that action."""
    return with_baseline(previous_physics(df, c), df, days, c)


TOKEN = ["pitch_number", "family", "pitch_type", "plate_x_br", "plate_z_norm", "release_speed",
         "pfx_x", "pfx_z", "release_spin_rate", "release_extension", "outcome"]


def _earlier(c: Cols):
    return (W.partitionBy(c.game, c.at_bat).orderBy(c.order)
            .rowsBetween(W.unboundedPreceding, -1))


def pa_history(df: DataFrame, fields: list[str] | None = None, c: Cols = PITCH) -> DataFrame:
    """Ordered tokens of the episode's earlier decisions; the first decision has none."""
    token = F.struct(*(fields or [f for f in TOKEN if f in df.columns]))
    return df.withColumn("history", F.collect_list(token).over(_earlier(c)))


def previous_pitch(df: DataFrame, fields: list[str] | None = None, depth: int = 1,
                   c: Cols = PITCH) -> DataFrame:
    """Columns of the last `depth` decisions: `prev_<field>`, `prev2_<field>`, ..."""
    w = W.partitionBy(c.game, c.at_bat).orderBy(c.order)
    out = {}
    for d in range(1, depth + 1):
        for f in fields or [x for x in TOKEN if x in df.columns and x != "pitch_number"]:
            out[f"prev{'' if d == 1 else d}_{f}"] = F.lag(f, d).over(w)
    return df.withColumns(out)


def chunked_lags(df: DataFrame, episode: list[str], chunk: str, order: list[str], field: str,
                 depth: int, start: str | None = None) -> DataFrame:
    """`seq` and the last `depth` values of `field` where an episode may be of any length.

    A pitch log bounds its episodes by the key; another log may have one actor fill an episode
    with a third of all rows. Windows then run inside (episode, chunk), where `chunk` is a time
    step in order, and only each chunk's size and last `depth` values cross to the next, by a
    window over chunks. `start` stands for "before the episode".
    """
    w = W.partitionBy(*episode, chunk).orderBy(*order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    inner = df.withColumns({
        "_r": F.row_number().over(w), "_n": F.count("*").over(whole),
        **{f"_lag{d}": F.lag(field, d).over(w) for d in range(1, depth + 1)}})
    tails = inner.filter(F.col("_n") - F.col("_r") < depth).groupBy(*episode, chunk).agg(
        F.max("_n").alias("_size"),
        F.sort_array(F.collect_list(F.struct("_r", F.col(field).alias("v")))).alias("_tail"))
    over = W.partitionBy(*episode).orderBy(chunk)
    none = F.array().cast("array<string>")
    last = [F.coalesce(F.transform(F.lag("_tail", d).over(over), lambda t: t["v"].cast("string")), none)
            for d in range(depth, 0, -1)]
    carried = tails.select(
        *episode, chunk,
        F.coalesce(F.sum("_size").over(over.rowsBetween(W.unboundedPreceding, -1)),
                   F.lit(0)).alias("_offset"),
        F.concat(*last).alias("_before"))
    joined = inner.join(carried, [*episode, chunk])
    out = {"seq": (F.col("_offset") + F.col("_r")).cast("int")}
    for d in range(1, depth + 1):
        back = F.col("_r") - d - 1  # -1 is the last value before this chunk
        earlier = F.when(back < 0, F.try_element_at("_before", back.cast("int")))
        value = F.coalesce(F.col(f"_lag{d}").cast("string"), earlier)
        out[f"prev{'' if d == 1 else d}_family"] = F.coalesce(value, F.lit(start)) if start else value
    return joined.withColumns(out).drop(
        "_r", "_n", "_offset", "_before", *[f"_lag{d}" for d in range(1, depth + 1)])


def sequence_array(df: DataFrame, length: int, c: Cols = PITCH, alphabet=FAMILIES) -> DataFrame:
    """History as fixed-length arrays for sequence models: `seq` holds action places (1-based,
    0 is padding) right-aligned, `seq_speed` the speeds, `seq_mask` what is real."""
    alpha = F.array(*[F.lit(a) for a in alphabet])
    recent = F.slice("history", F.greatest(F.size("history") - length, F.lit(0)) + 1, length)
    missing = F.lit(length) - F.least(F.size("history"), F.lit(length))

    def padded(value, fill):
        return F.concat(F.array_repeat(F.lit(fill), missing), F.transform(recent, value))

    return (
        pa_history(df, [c.action, "release_speed"], c)
        .withColumn("seq", padded(lambda t: F.array_position(alpha, t[c.action]).cast("int"), 0))
        .withColumn("seq_speed", padded(lambda t: F.coalesce(t["release_speed"], F.lit(0.0)), 0.0))
        .withColumn("seq_mask", padded(lambda t: F.lit(1), 0))
        .drop("history")
    )


def matchup_game(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    """Earlier at-bats of this pair in this game."""
    w = (W.partitionBy(c.game, c.actor, c.opponent).orderBy(c.at_bat)
         .rangeBetween(W.unboundedPreceding, -1))
    rank = W.partitionBy(c.game, c.actor, c.opponent).orderBy(c.at_bat)
    return (
        df.withColumn("mg_pa", F.dense_rank().over(rank) - 1)
        .withColumn("mg_n", F.count(c.reward).over(w))
        .withColumn("mg_sum", F.coalesce(F.sum(c.reward).over(w), F.lit(0.0)))
    )


def _pair_days(df: DataFrame, c: Cols) -> DataFrame:
    return df.groupBy(c.actor, c.opponent, c.season, c.date).agg(
        F.count(c.reward).alias("_n"), F.coalesce(F.sum(c.reward), F.lit(0.0)).alias("_s"))


def _over(w, n: str, s: str) -> list[Column]:
    return [F.coalesce(F.sum("_n").over(w), F.lit(0)).alias(n),
            F.coalesce(F.sum("_s").over(w), F.lit(0.0)).alias(s)]


def _season_frame(c: Cols):
    return (W.partitionBy(c.actor, c.opponent, c.season).orderBy(F.unix_date(c.date))
            .rangeBetween(W.unboundedPreceding, -1))


def _older_frame(c: Cols):
    return (W.partitionBy(c.actor, c.opponent).orderBy(c.season)
            .rangeBetween(W.unboundedPreceding, -1))


def matchup_season(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    """Per pair and date: meetings earlier this season."""
    return _pair_days(df, c).select(c.actor, c.opponent, c.date,
                                    *_over(_season_frame(c), "ms_n", "ms_sum"))


def matchup_older(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    """Per pair and date: meetings in earlier seasons."""
    return _pair_days(df, c).select(c.actor, c.opponent, c.date,
                                    *_over(_older_frame(c), "mo_n", "mo_sum"))


def matchup_meetings(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    """Both of the above from one pair-day table and one exchange."""
    return _pair_days(df, c).select(
        c.actor, c.opponent, c.date,
        *_over(_older_frame(c), "mo_n", "mo_sum"), *_over(_season_frame(c), "ms_n", "ms_sum"))


def batter_vs_family(df: DataFrame, c: Cols = PITCH, alphabet=FAMILIES) -> DataFrame:
    """Per opponent and date: earlier results against every action, as two arrays."""
    sums = {}
    for i, a in enumerate(alphabet):
        hit = (F.col(c.action) == a) & F.col(c.reward).isNotNull()
        sums[f"_n{i}"] = _flag(hit)
        sums[f"_s{i}"] = F.when(hit, F.col(c.reward)).otherwise(F.lit(0.0))
    t = trailing(df, [c.opponent], sums, None, c)
    return t.select(
        c.opponent, c.date,
        F.array(*[F.col(f"_n{i}") for i in range(len(alphabet))]).alias("bf_n"),
        F.array(*[F.col(f"_s{i}") for i in range(len(alphabet))]).alias("bf_sum"),
    )


def pitcher_vs_hand(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    """Per actor, opponent side and date: earlier results."""
    return trailing(df, [c.actor, "stand"], {
        "ph_n": _flag(F.col(c.reward).isNotNull()),
        "ph_sum": F.coalesce(F.col(c.reward), F.lit(0.0)),
    }, None, c)


def with_meetings(df: DataFrame, source: DataFrame, c: Cols = PITCH,
                  side: Callable[[DataFrame], DataFrame] = as_is) -> DataFrame:
    """Join the cross-game buckets, taken from `source`, as of the game's date."""
    return (
        df.join(side(matchup_meetings(source, c)), [c.actor, c.opponent, c.date], "left")
        .join(side(batter_vs_family(source, c)), [c.opponent, c.date], "left")
        .join(side(pitcher_vs_hand(source, c)), [c.actor, "stand", c.date], "left")
    )


def matchup_memory(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    """All buckets of earlier results next to each decision."""
    return with_meetings(matchup_game(df, c), df, c)


def pooled_matchup(df: DataFrame, k: float) -> DataFrame:
    """Pair results shrunk to the opponent's and the actor's own means.

    Reads the columns of `matchup_memory`. A pair meets too rarely for its raw mean.
    """
    bn = F.aggregate("bf_n", F.lit(0).cast("long"), lambda a, x: a + x)
    bs = F.aggregate("bf_sum", F.lit(0.0), lambda a, x: a + x)
    b = F.try_divide(bs, bn)
    p = F.try_divide(F.col("ph_sum"), F.col("ph_n"))
    prior = F.coalesce((b + p) / 2, b, p, F.lit(0.0))
    n = F.col("mg_n") + F.col("ms_n") + F.col("mo_n")
    s = F.col("mg_sum") + F.col("ms_sum") + F.col("mo_sum")
    return df.withColumn("pair_n", n).withColumn(
        "pooled_reward", (s + F.lit(k) * prior) / (n + F.lit(k)))


def episode_return(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    """Sum of rewards per episode, beside the running total at its last decision."""
    running = (W.partitionBy(c.game, c.at_bat).orderBy(c.order)
               .rowsBetween(W.unboundedPreceding, 0))
    rows = df.select(c.game, c.at_bat, c.episode, c.order, c.reward).withColumn(
        "_running", F.sum(c.reward).over(running))
    return rows.groupBy(c.game, c.at_bat, c.episode).agg(
        F.count("*").alias("n"), F.sum(c.reward).alias("g"),
        F.max_by("_running", c.order).alias("terminal"),
    ).drop(c.game, c.at_bat)


def assert_episode_return(df: DataFrame, tolerance: float = 1e-9, c: Cols = PITCH) -> DataFrame:
    off = episode_return(df, c).filter(
        ~F.col("g").eqNullSafe(F.col("terminal"))
        & (F.coalesce(F.abs(F.col("g") - F.col("terminal")), F.lit(1.0)) > tolerance))
    if not off.isEmpty():
        raise ValueError(f"episode return and terminal total differ: {off.first()}")
    return df


def _half_inning(c: Cols):
    return W.partitionBy(c.game, "inning", "inning_topbot")


def run_expectancy_table(df: DataFrame, train: Column, c: Cols = PITCH) -> DataFrame:
    """Mean runs still to come in the half-inning by bases, outs and count (288 states at most)."""
    to_come = F.max("post_bat_score").over(_half_inning(c)) - F.col("bat_score")
    return (
        df.filter(train).withColumn("_to_come", to_come)
        .groupBy("base_state", "outs_when_up", "count_state")
        .agg(F.count("*").alias("n"), F.avg("_to_come").alias("run_exp"))
    )


def recomputed_reward(df: DataFrame, table: DataFrame, c: Cols = PITCH) -> DataFrame:
    """Reward from our own run-expectancy table instead of the supplied one."""
    w = _half_inning(c).orderBy(c.at_bat, c.order)
    state = ["base_state", "outs_when_up", "count_state"]
    joined = df.join(small_side(table.select(*state, "run_exp")), state, "left")
    after = F.when(F.lead(F.lit(1)).over(w).isNull(), F.lit(0.0)).otherwise(
        F.lead("run_exp").over(w))
    scored = F.col("post_bat_score") - F.col("bat_score")
    return joined.withColumn("reward_recomputed",
                             F.lit(0.0) - (after - F.col("run_exp") + scored))
