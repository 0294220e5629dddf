"""Prediction contract, scores, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from throughline.config import FAMILIES
from throughline.functions import hashing
from throughline.functions.arrays import prob_of, total
from throughline.functions.scalars import bucket
from throughline.operators import decision
from throughline.session import small_side, stage

EPS = 1e-12

PREDICTIONS = T.StructType([
    T.StructField("row_id", T.LongType(), False),
    T.StructField("state_view", T.StringType(), False),
    T.StructField("model_id", T.StringType(), False),
    T.StructField("action_probs", T.ArrayType(T.DoubleType())),
    T.StructField("outcome_probs", T.ArrayType(T.DoubleType())),
    T.StructField("exp_reward", T.DoubleType()),
    T.StructField("exp_reward_sd", T.DoubleType()),
    T.StructField("policy_probs", T.ArrayType(T.DoubleType())),
    T.StructField("seconds", T.DoubleType()),
    T.StructField("peak_mem_mb", T.DoubleType()),
    T.StructField("n_params", T.LongType()),
])


def conform(df: DataFrame) -> DataFrame:
    """The contract's columns in order; what a model does not produce is null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in PREDICTIONS.fields])


def validate(df: DataFrame, width: int = len(FAMILIES)) -> DataFrame:
    """One row of violation counts; all zero for a sound prediction table."""
    def unsound(col):
        p = F.col(col)
        return p.isNotNull() & ((F.size(p) != width) | (F.abs(total(p) - 1) > 1e-6)
                                | F.exists(p, lambda x: x.isNull() | (x < 0)))

    return df.groupBy("row_id", "state_view", "model_id").agg(
        F.count("*").alias("_n"), F.count_if(unsound("action_probs")).alias("_a"),
        F.count_if(unsound("policy_probs")).alias("_p"),
    ).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.count_if(F.col("_n") > 1).alias("n_duplicated"),
        F.coalesce(F.sum("_a"), F.lit(0)).alias("n_bad_action_probs"),
        F.coalesce(F.sum("_p"), F.lit(0)).alias("n_bad_policy_probs"),
    )


def assert_valid(df: DataFrame, width: int = len(FAMILIES)) -> DataFrame:
    got = validate(df, width).first()
    if got.n_duplicated or got.n_bad_action_probs or got.n_bad_policy_probs:
        raise decision.ContractError(f"prediction table is unsound: {got.asDict()}")
    return df


def log_loss_of(probs: Column, action: Column, alphabet=FAMILIES) -> Column:
    return -F.log(F.greatest(prob_of(probs, action, alphabet), F.lit(EPS)))


def brier_of(probs: Column, action: Column, alphabet=FAMILIES) -> Column:
    """Sum of squared distances to the one-hot truth: sum(p^2) - 2 p_true + 1."""
    squares = F.aggregate(probs, F.lit(0.0), lambda a, x: a + x * x)
    return squares - 2 * prob_of(probs, action, alphabet) + 1


def rank_of(probs: Column, action: Column, alphabet=FAMILIES) -> Column:
    mine = prob_of(probs, action, alphabet)
    return F.size(F.filter(probs, lambda x: x > mine)) + 1


def scored(pred: DataFrame, action: str = "family", probs: str = "action_probs",
           alphabet=FAMILIES) -> DataFrame:
    """Per-row losses next to the predictions."""
    p, a = F.col(probs), F.col(action)
    return pred.withColumns({
        "loss": log_loss_of(p, a, alphabet), "brier": brier_of(p, a, alphabet),
        "rank": rank_of(p, a, alphabet),
    })


def log_loss(pred: DataFrame, by: list[str], **kw) -> DataFrame:
    return scored(pred, **kw).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("loss").alias("log_loss"))


def brier(pred: DataFrame, by: list[str], **kw) -> DataFrame:
    return scored(pred, **kw).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("brier").alias("brier"))


def topk_accuracy(pred: DataFrame, by: list[str], ks=(1, 2), **kw) -> DataFrame:
    return scored(pred, **kw).groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.avg((F.col("rank") <= k).cast("double")).alias(f"top{k}") for k in ks])


def macro_f1(pred: DataFrame, by: list[str], action: str = "family",
             probs: str = "action_probs", alphabet=FAMILIES) -> DataFrame:
    """Mean F1 over the actions that occur or are predicted."""
    best = F.array_position(F.col(probs), F.array_max(probs)).cast("int")
    guess = F.element_at(F.array(*[F.lit(a) for a in alphabet]), best)
    confusion = pred.groupBy(*by, F.col(action).alias("_true"), guess.alias("_guess")).agg(
        F.count("*").alias("_n"))
    sides = F.array(
        F.struct(F.col("_true").alias("cls"), F.col("_n").alias("t"), F.lit(0).cast("long").alias("g"),
                 F.when(F.col("_true") == F.col("_guess"), F.col("_n")).otherwise(0).alias("h")),
        F.struct(F.col("_guess").alias("cls"), F.lit(0).cast("long").alias("t"), F.col("_n").alias("g"),
                 F.lit(0).cast("long").alias("h")))
    per_class = confusion.select(*by, F.inline(sides)).groupBy(*by, "cls").agg(
        F.sum("t").alias("_t"), F.sum("g").alias("_g"), F.sum("h").alias("_h"))
    return per_class.groupBy(*by).agg(
        F.count("*").alias("n_classes"),
        F.avg(2 * F.col("_h") / (F.col("_t") + F.col("_g"))).alias("macro_f1"))


def macro_micro(rows: DataFrame, by: list[str], value: str = "loss",
                actor: str = "pitcher") -> DataFrame:
    """Row-weighted mean, and mean of the actors' own means."""
    per = rows.groupBy(*by, actor).agg(F.count(value).alias("_n"), F.sum(value).alias("_s"))
    return per.groupBy(*by).agg(
        F.sum("_n").alias("n"), F.count("*").alias("n_actors"),
        (F.sum("_s") / F.sum("_n")).alias("micro"), F.avg(F.col("_s") / F.col("_n")).alias("macro"))


def calibration_sums(pred: DataFrame, bins: int, by: list[str], action: str = "family",
                     probs: str = "action_probs", alphabet=FAMILIES) -> DataFrame:
    """Per group, forecast action and probability bin: rows, summed forecast, summed truth."""
    cells = F.array(*[
        F.struct(F.lit(a).alias("forecast"), F.col(probs)[i].alias("_p"),
                 (F.col(action) == a).cast("double").alias("_y"))
        for i, a in enumerate(alphabet)])
    rows = pred.select(*by, F.inline(cells))
    return rows.groupBy(*by, "forecast", bucket(F.col("_p"), bins).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("_p").alias("_p"), F.sum("_y").alias("_y"))


def calibration(pred: DataFrame, bins: int, by: list[str], **kw) -> DataFrame:
    """Reliability: mean forecast and observed frequency per probability bin.

    `forecast` in `by` splits by the forecast action.
    """
    t = calibration_sums(pred, bins, [b for b in by if b != "forecast"], **kw)
    return t.groupBy(*by, "bin").agg(
        F.sum("n").alias("n"), (F.sum("_p") / F.sum("n")).alias("mean_p"),
        (F.sum("_y") / F.sum("n")).alias("observed"))


def calibration_breakouts(pred: DataFrame, bins: int, by: list[str],
                          breakouts: dict[str, Column | None], **kw) -> DataFrame:
    """Several reliability curves in one pass: rows (by, breakout, level, bin). A breakout given
    as None splits by the forecast action."""
    cells = F.array(*[
        F.struct(F.lit(n).alias("breakout"), (F.lit(None) if v is None else v).cast("string").alias("_level"))
        for n, v in breakouts.items()])
    rows = pred.select("*", F.inline(cells))
    t = calibration_sums(rows, bins, [*by, "breakout", "_level"], **kw)
    level = F.coalesce("_level", "forecast").alias("level")
    return t.groupBy(*by, "breakout", level, "bin").agg(
        F.sum("n").alias("n"), (F.sum("_p") / F.sum("n")).alias("mean_p"),
        (F.sum("_y") / F.sum("n")).alias("observed"))


def skill(pred: DataFrame, by: list[str], action: str = "family", probs: str = "action_probs",
          base: str = "base_probs") -> DataFrame:
    """1 - loss / baseline loss over all rows; both forecasts are columns of one table."""
    mine, theirs = (log_loss_of(F.col(p), F.col(action)) for p in (probs, base))
    return pred.groupBy(*by).agg(F.count("*").alias("n"), (1 - F.avg(mine) / F.avg(theirs)).alias("skill"))


def value_error(pred: DataFrame, by: list[str], reward: str = "reward",
                forecast: str = "exp_reward") -> DataFrame:
    e = F.col(reward) - F.col(forecast)
    return pred.filter(F.col(reward).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def value_calibration(pred: DataFrame, by: list[str], reward: str = "reward",
                      forecast: str = "exp_reward") -> DataFrame:
    return pred.filter(F.col(reward).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.regr_intercept(F.col(reward), F.col(forecast)).alias("intercept"),
        F.regr_slope(F.col(reward), F.col(forecast)).alias("slope"))


def quantiles(df: DataFrame, value: str, asked: list[tuple[int, int]], by: list[str] | None = None) -> DataFrame:
    """(by, quantile, value): exact quantiles, `quantile` being the place in `asked` of the fraction (numerator, denominator).

    The quantile of n values is the ceil(n * fraction)-th least of them. Distinct values are counted first, dealt
    out by range and written; a value's rank is then the sum of the ranges before its own, which are a few rows
    each, and a running sum inside the range. Nulls don't count; a group of nothing else has no rows.
    """
    by = by or []
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("_n"))
    ranges = stage(counted.repartitionByRange(*by, "value").withColumn("_part", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy(*by, "_part").agg(F.sum("_n").alias("_s"))
    line = W.partitionBy(*by).orderBy("_part")
    before = F.sum("_s").over(line.rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(*by, "_part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_s").over(W.partitionBy(*by)).alias("_all"))
    up_to = F.sum("_n").over(W.partitionBy(*by, "_part").orderBy("value")) + F.col("_before")
    ranked = ranges.join(small_side(sums), [*by, "_part"]).withColumn("_to", up_to)
    cells = F.array(*[F.struct(F.lit(i).alias("quantile"), F.greatest(F.lit(1), F.floor((F.col("_all") * num + (den - 1)) / den)).alias("_rank"))
                      for i, (num, den) in enumerate(asked)])
    return (ranked.select(*by, "value", "_n", "_to", F.inline(cells))
            .filter("_to - _n < _rank and _rank <= _to").select(*by, "quantile", "value"))


def decile_cuts(pred: DataFrame, value: str) -> Column:
    """The nine exact cut points, as an array."""
    cuts = quantiles(pred, value, [(i, 10) for i in range(1, 10)])
    return cuts.agg(F.array_sort(F.collect_list("value"))).scalar()


def reward_by_action_decile(pred: DataFrame, cuts: Column, action: str = "family",
                            propensity: str = "propensity", reward: str = "reward",
                            forecast: str = "exp_reward") -> DataFrame:
    rows = pred.filter(F.col(reward).isNotNull()).withColumn("_cuts", cuts)
    decile = F.size(F.filter("_cuts", lambda x: x <= F.col(propensity)))
    return rows.groupBy(action, decile.alias("decile")).agg(
        F.count("*").alias("n"), F.avg(reward).alias("observed"), F.avg(forecast).alias("predicted"))


def event_loss(rows: DataFrame, nodes: dict[str, tuple[str, list[str]]],
               by: list[str]) -> DataFrame:
    """Loss per tree node over the rows reaching it, and of the final event.

    `nodes` maps a node name to its label column and alphabet; forecasts are in `<node>_probs`.
    The event's probability is the product along its path, so its log loss is the sum over the
    nodes reached.
    """
    cells, path = [], F.lit(0.0)
    for name, (label, alphabet) in nodes.items():
        p, y = F.col(f"{name}_probs"), F.col(label)
        loss = F.when(y.isNotNull(), log_loss_of(p, y, alphabet))
        cells.append(F.struct(F.lit(name).alias("node"), loss.alias("_loss"),
                              F.when(y.isNotNull(), brier_of(p, y, alphabet)).alias("_brier")))
        path = path + F.coalesce(loss, F.lit(0.0))
    first_label = F.col(next(iter(nodes.values()))[0])
    cells.append(F.struct(F.lit("event").alias("node"), F.when(first_label.isNotNull(), path).alias("_loss"),
                          F.lit(None).cast("double").alias("_brier")))
    long = rows.select(*by, F.inline(F.array(*cells)))
    return long.filter(F.col("_loss").isNotNull()).groupBy(*by, "node").agg(
        F.count("*").alias("n"), F.avg("_loss").alias("log_loss"), F.avg("_brier").alias("brier"))


def ablation_delta(losses: DataFrame, by: list[str]) -> DataFrame:
    """What order and matchup memory are worth, from rows holding one loss column per view.

    The better of U and L1 is chosen on mean loss, not row by row.
    """
    means = losses.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.avg(f"loss_{v.lower()}").alias(f"loss_{v.lower()}") for v in ("C", "U", "L1", "O", "OM")])
    return means.withColumns({
        "delta_order": F.least("loss_u", "loss_l1") - F.col("loss_o"),
        "delta_matchup": F.col("loss_o") - F.col("loss_om"),
    })


def bootstrap(df: DataFrame, cluster: list[str], sums: dict[str, Column], by: list[str],
              replicates: int, seed: int) -> DataFrame:
    """Poisson bootstrap over clusters: weighted sums per replicate, replicate 0 unweighted.

    Rows are first summed to one row per group and cluster, and a cluster's groups are put into one
    row. That draws a weight per replicate from hashes of its key: a digest carries four of them,
    and all groups share it. The copies are reduced in the same task before any shuffle, so what
    moves is one row per task, group and four replicates.
    """
    if taken := {"_cells", "_four", "_hex", "_w0", "_w1", "_w2", "_w3", "replicate"} & set(sums):
        raise ValueError(f"names that the draws use themselves: {sorted(taken)}")
    per_cluster = df.groupBy(*by, *cluster).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    own = [x for x in by if x not in cluster]
    if own:
        shared = [x for x in by if x in cluster]
        rows = per_cluster.groupBy(*cluster).agg(F.collect_list(F.struct(*own, *sums)).alias("_cells"))
    else:
        shared, rows = by, per_cluster
    draw = rows.withColumn("_four", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates // 4).cast("long"))))
    draw = draw.withColumn("_hex", hashing.digest(seed, *cluster, F.col("_four")))  # a column of its own: one digest, not one per cut point
    weights = [hashing.poisson_one(hashing.piece(F.col("_hex"), lane)) for lane in range(4)]
    weights[0] = F.when(F.col("_four") == 0, F.lit(1)).otherwise(weights[0])
    draw = draw.select(*shared, "_four", F.col("_cells") if own else F.struct(*sums).alias("_cells"), *[w.alias(f"_w{i}") for i, w in enumerate(weights)])
    ws = [f"_w{i}" for i in range(4)]
    cells = draw.select(*shared, "_four", *ws, F.inline("_cells") if own else F.col("_cells.*"))
    fours = cells.groupBy(*by, "_four").agg(*[F.sum(F.col(w) * F.col(k)).alias(f"{k}{w}") for w in ws for k in sums])
    each = F.array(*[F.struct((F.col("_four") * 4 + i).cast("int").alias("replicate"), *[F.col(f"{k}{w}").alias(k) for k in sums])
                     for i, w in enumerate(ws)])
    return fours.select(*by, F.inline(each)).filter(F.col("replicate") <= replicates)


def drawn(value: str) -> Column:
    """The value in the random replicates only."""
    return F.when(F.col("replicate") > 0, F.col(value))


def observed(value: str) -> Column:
    return F.max(F.when(F.col("replicate") == 0, F.col(value)))


def interval(reps: DataFrame, by: list[str], value: str, lo: float = 0.025,
             hi: float = 0.975) -> DataFrame:
    """Observed value and percentile bounds over the replicates."""
    return reps.groupBy(*by).agg(
        observed(value).alias("value"), F.percentile(drawn(value), lo).alias("lo"),
        F.percentile(drawn(value), hi).alias("hi"))


def delta_intervals(losses: DataFrame, cluster: list[str], by: list[str], replicates: int,
                    seed: int) -> DataFrame:
    """Order and matchup gains with their bootstrap intervals."""
    sums = {"n": F.lit(1.0), **{f"s_{v}": F.col(f"loss_{v}") for v in ("u", "l1", "o", "om")}}
    reps = bootstrap(losses, cluster, sums, by, replicates, seed)
    rows = reps.filter(F.col("n") > 0).withColumns({
        "order": (F.least("s_u", "s_l1") - F.col("s_o")) / F.col("n"),
        "matchup": (F.col("s_o") - F.col("s_om")) / F.col("n"),
    })
    return rows.groupBy(*by).agg(*[
        x for d in ("order", "matchup") for x in (
            observed(d).alias(f"delta_{d}"), F.percentile(drawn(d), 0.025).alias(f"{d}_lo"),
            F.percentile(drawn(d), 0.975).alias(f"{d}_hi"))])


def compute_frontier(models: DataFrame, value: str, cost: str, key: str = "model_id") -> DataFrame:
    """Models no other model beats on both value and cost (one row per model)."""
    o = models.select(*[F.col(x).alias(f"_{x}") for x in (key, value, cost)])
    beaten = (
        (F.col(f"_{value}") >= F.col(value)) & (F.col(f"_{cost}") <= F.col(cost))
        & ((F.col(f"_{value}") > F.col(value)) | (F.col(f"_{cost}") < F.col(cost))))
    return models.join(F.broadcast(o), beaten, "left_anti")


def harness(pred: DataFrame, replicates: int, seed: int, cluster: list[str],
            action: str = "family", actor: str = "pitcher") -> DataFrame:
    """The whole battery for one prediction table, long: one row per slice and metric.

    Means over rows come with clustered intervals; macro F1 and the actors' equal-weight loss
    are points. Needs the columns of the decision rows beside the predictions.
    """
    by = ["model_id", "state_view", "slice"]
    rows = decision.with_slices(scored(pred, action))
    means = {"log_loss": F.col("loss"), "brier": F.col("brier"),
             "top1": (F.col("rank") <= 1).cast("double"), "top2": (F.col("rank") <= 2).cast("double")}
    reps = bootstrap(rows, cluster, {"_n": F.lit(1.0), **means}, by, replicates, seed)
    long = reps.filter(F.col("_n") > 0).select(*by, "replicate", F.inline(F.array(*[
        F.struct(F.lit(k).alias("metric"), (F.col(k) / F.col("_n")).alias("_v")) for k in means])))
    out = interval(long, [*by, "metric"], "_v")
    empty = F.lit(None).cast("double")
    for name, point in (
        ("macro_f1", macro_f1(rows, by, action).withColumnRenamed("macro_f1", "value")),
        ("macro_log_loss", macro_micro(rows, by, "loss", actor).withColumnRenamed("macro", "value")),
    ):
        out = out.unionByName(point.select(
            *by, F.lit(name).alias("metric"), "value", empty.alias("lo"), empty.alias("hi")))
    return out
