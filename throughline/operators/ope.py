"""Off-policy evaluation: estimators, diagnostics, self-tests, verdict.

Logged rows carry arrays `mu`, `pi` and `q` in family order next to the action and its reward.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from throughline.config import FAMILIES, PITCH, Cols
from throughline.functions import hashing
from throughline.functions.arrays import dot, entropy_ratio, prob_of, total, variation
from throughline.operators.metrics import bootstrap, drawn, observed, quantiles


def clip_weights(w: Column, cap: float | None) -> Column:
    return w if cap is None else F.least(w, F.lit(cap))


def logged(df: DataFrame, cap: float | None = None, c: Cols = PITCH) -> DataFrame:
    """Rows with a reward, plus `w` (importance ratio), `q_a` and `v_hat` (value of pi under q)."""
    mu_a = prob_of(F.col("mu"), F.col(c.action), FAMILIES)
    pi_a = prob_of(F.col("pi"), F.col(c.action), FAMILIES)
    return df.filter(F.col(c.reward).isNotNull()).withColumns({
        "w": clip_weights(pi_a / mu_a, cap),
        "q_a": prob_of(F.col("q"), F.col(c.action), FAMILIES),
        "v_hat": dot(F.col("pi"), F.col("q")),
        "mu_a": mu_a,
    })


def _terms(reward: str) -> dict[str, Column]:
    r, w = F.col(reward), F.col("w")
    return {"dm": F.col("v_hat"), "ips": w * r, "w": w,
            "dr": F.col("v_hat") + w * (r - F.col("q_a"))}


def estimates(rows: DataFrame, by: list[str], c: Cols = PITCH) -> DataFrame:
    """DM, IPS, SNIPS and DR in one pass."""
    t = _terms(c.reward)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(c.reward).alias("observed"),
        F.avg(t["dm"]).alias("dm"), F.avg(t["ips"]).alias("ips"),
        (F.sum(t["ips"]) / F.sum(t["w"])).alias("snips"), F.avg(t["dr"]).alias("dr"))


def episode_estimates(rows: DataFrame, by: list[str], c: Cols = PITCH) -> DataFrame:
    """Observed value, DM and DR summed over an episode, to stand beside full-episode values."""
    t = _terms(c.reward)
    per = rows.groupBy(*by, c.episode).agg(
        F.sum(c.reward).alias("observed"), F.sum(t["dm"]).alias("dm"), F.sum(t["dr"]).alias("dr"))
    return per.groupBy(*by).agg(*[F.avg(x).alias(x) for x in ("observed", "dm", "dr")])


def dm(rows: DataFrame, by: list[str]) -> DataFrame:
    return estimates(rows, by).select(*by, "dm")


def ips(rows: DataFrame, by: list[str]) -> DataFrame:
    return estimates(rows, by).select(*by, "ips")


def snips(rows: DataFrame, by: list[str]) -> DataFrame:
    return estimates(rows, by).select(*by, "snips")


def dr(rows: DataFrame, by: list[str]) -> DataFrame:
    return estimates(rows, by).select(*by, "dr")


def stepwise_dr(rows: DataFrame, by: list[str], c: Cols = PITCH) -> DataFrame:
    """Episode value by the backward recursion V = v_hat + w (R + V_next - q), averaged.

    One array per episode; the key contract keeps an episode under 100 decisions.
    """
    step = F.struct(F.col(c.order).alias("t"), "v_hat", "w", F.col(c.reward).alias("r"), "q_a")
    per = rows.groupBy(*by, c.episode).agg(F.collect_list(step).alias("_steps"))
    back = F.reverse(F.array_sort("_steps"))
    value = F.aggregate(back, F.lit(0.0),
                        lambda v, s: s["v_hat"] + s["w"] * (s["r"] + v - s["q_a"]))
    return per.select(*by, value.alias("_v")).groupBy(*by).agg(
        F.count("*").alias("n_episodes"), F.avg("_v").alias("stepwise_dr"))


def mixture_episodes(rows: DataFrame, alphas: tuple[float, ...], mix: Callable[[Column, Column, Column], Column], by: list[str],
                     cap: float | None = None, c: Cols = PITCH) -> DataFrame:
    """`episode_estimates` and `stepwise_dr` of all mixtures of `mu` and `target`, by `alpha`, from one exchange by episode.

    A row carries a weight and a value per mixture; it is not copied for each of them before it has moved.
    """
    pi = {f"_pi{k}": mix(F.col("mu"), F.col("target"), F.lit(float(a))) for k, a in enumerate(alphas)}
    df = rows.filter(F.col(c.reward).isNotNull()).withColumns({
        **pi, "q_a": prob_of(F.col("q"), F.col(c.action), FAMILIES), "mu_a": prob_of(F.col("mu"), F.col(c.action), FAMILIES)})
    r = F.col(c.reward)
    df = df.select(*by, c.episode, F.col(c.order).alias("t"), r.alias("r"), "q_a",
                   F.array(*[dot(F.col(p), F.col("q")) for p in pi]).alias("v"),
                   F.array(*[clip_weights(prob_of(F.col(p), F.col(c.action), FAMILIES) / F.col("mu_a"), cap) for p in pi]).alias("w"))
    per = df.groupBy(*by, c.episode).agg(
        F.sum("r").alias("observed"), F.array_sort(F.collect_list(F.struct("t", "v", "w", "r", "q_a"))).alias("_steps"),
        *[F.sum(F.col("v")[k]).alias(f"_dm{k}") for k in range(len(pi))],
        *[F.sum(F.col("v")[k] + F.col("w")[k] * (F.col("r") - F.col("q_a"))).alias(f"_dr{k}") for k in range(len(pi))])
    back = F.reverse("_steps")

    def value(k: int) -> Column:
        return F.aggregate(back, F.lit(0.0), lambda v, s: s["v"][k] + s["w"][k] * (s["r"] + v - s["q_a"]))

    long = per.select(*by, "observed", F.inline(F.array(*[F.struct(
        F.lit(float(a)).alias("alpha"), F.col(f"_dm{k}").alias("dm"), F.col(f"_dr{k}").alias("dr"), value(k).alias("_v"))
        for k, a in enumerate(alphas)])))
    return long.groupBy(*by, "alpha").agg(*[F.avg(x).alias(x) for x in ("observed", "dm", "dr")],
                                          F.count("*").alias("n_episodes"), F.avg("_v").alias("stepwise_dr"))


def fqe_value(starts: DataFrame, q: DataFrame, by: list[str],
              state: str = "count_state") -> DataFrame:
    """Policy value at the episodes' first states from a fitted Q table (by, state, action, pi, q)."""
    v = q.groupBy(*by, F.col("state").alias(state)).agg(
        (F.sum(F.col("pi") * F.col("q")) / F.sum("pi")).alias("_v"))
    counts = starts.groupBy(state).agg(F.count("*").alias("_n"))
    return counts.join(v, state).groupBy(*by).agg(
        (F.sum(F.col("_n") * F.col("_v")) / F.sum("_n")).alias("fqe"))


def ope_diagnostics(rows: DataFrame, by: list[str], floor: float, rare: float) -> DataFrame:
    """Effective sample size, weight tail (exact), support."""
    tail = quantiles(rows, "w", [(99, 100)], by).select(*by, F.col("value").alias("q99_weight"))
    pairs = F.arrays_zip(F.col("pi"), F.col("mu"))
    outside = F.exists(pairs, lambda z: (z["pi"] > 0) & (z["mu"] < F.lit(floor)))
    rare_mass = total(F.zip_with("pi", "mu", lambda p, m: F.when(m < rare, p).otherwise(F.lit(0.0))))
    whole = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        (F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w"))).alias("ess"),
        F.max("w").alias("max_weight"),
        F.avg(outside.cast("double")).alias("oos_support_frac"),
        F.avg(rare_mass).alias("rare_action_frac"))
    return whole.join(tail, by) if by else whole.withColumn("q99_weight", tail.select("q99_weight").scalar())


def policy_distance(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.avg(entropy_ratio(F.col("pi"), F.col("mu"))).alias("kl_from_behavior"),
        F.avg(variation(F.col("pi"), F.col("mu"))).alias("tv_from_behavior"))


def value_interval(rows: DataFrame, by: list[str], cluster: list[str], replicates: int, seed: int,
                   c: Cols = PITCH) -> DataFrame:
    """DR value with its one-sided 95% lower bound and the two-sided interval."""
    term = _terms(c.reward)["dr"]
    reps = bootstrap(rows, cluster, {"_n": F.lit(1.0), "_s": term}, by, replicates, seed)
    reps = reps.filter(F.col("_n") > 0).withColumn("_v", F.col("_s") / F.col("_n"))
    return reps.groupBy(*by).agg(
        observed("_v").alias("value"), F.percentile(drawn("_v"), 0.05).alias("lower_95"),
        F.percentile(drawn("_v"), 0.025).alias("lo"), F.percentile(drawn("_v"), 0.975).alias("hi"))


def estimator_intervals(rows: DataFrame, by: list[str], truth: Column, cluster: list[str], replicates: int, seed: int,
                        c: Cols = PITCH) -> DataFrame:
    """One row per estimator: its value with clustered bounds, and the mean of `truth`, what it should have found.

    All estimators come from the same sums per cluster, so they see the same draws.
    """
    terms = _terms(c.reward)
    sums = {"_n": F.lit(1.0), "_truth": truth, **{f"_sum_{k}": v for k, v in terms.items()}}
    reps = bootstrap(rows, cluster, sums, by, replicates, seed).filter((F.col("_n") > 0) & (F.col("_sum_w") > 0))
    values = {"dm": F.col("_sum_dm") / F.col("_n"), "ips": F.col("_sum_ips") / F.col("_n"),
              "snips": F.col("_sum_ips") / F.col("_sum_w"), "dr": F.col("_sum_dr") / F.col("_n")}
    long = reps.select(*by, "replicate", (F.col("_truth") / F.col("_n")).alias("_t"), F.inline(F.array(*[
        F.struct(F.lit(k).alias("estimator"), v.alias("_v")) for k, v in values.items()])))
    return long.groupBy(*by, "estimator").agg(
        observed("_t").alias("truth"), observed("_v").alias("value"), F.percentile(drawn("_v"), 0.025).alias("lo"),
        F.percentile(drawn("_v"), 0.975).alias("hi"), F.percentile(drawn("_v"), 0.05).alias("lower_95"))


def self_tests(intervals: DataFrame, slack: float = 1e-9) -> DataFrame:
    """`passed` where an estimator's bounds hold the value it should have found."""
    return intervals.withColumn("passed", (F.col("lo") - slack <= F.col("truth")) & (F.col("truth") <= F.col("hi") + slack))


def gated_verdict(report: DataFrame, tolerance: float, names=("dm", "dr", "fqe"), baseline: str = "observed") -> DataFrame:
    """GAIN only if the gate is open, the estimators agree, and the value's lower bound is above what was observed a decision.

    A closed gate, estimators further apart than the tolerance and gains of different signs are INCONCLUSIVE.
    """
    judged = agreement_verdict(report, tolerance, names, baseline).withColumnRenamed("verdict", "_v")
    above = F.col("lower_95") > F.col("observed_decision")
    verdict = (F.when(~F.col("gate_open") | (F.col("_v") == "INCONCLUSIVE"), "INCONCLUSIVE")
               .when((F.col("_v") == "GAIN") & above, "GAIN").otherwise("NO GAIN"))
    return judged.withColumn("verdict", verdict).drop("_v")


def agreement_verdict(table: DataFrame, tolerance: float, names=("dm", "dr", "fqe"),
                      baseline: str = "observed") -> DataFrame:
    """GAIN or NO GAIN where the estimators agree, INCONCLUSIVE where they differ by more than
    the tolerance or in the sign of the gain."""
    cols = [F.col(x) for x in names]
    gap = F.greatest(*cols) - F.least(*cols)
    up = [(x > F.col(baseline)).cast("int") for x in cols]
    votes = up[0]
    for u in up[1:]:
        votes = votes + u
    verdict = (
        F.when(gap.isNull() | (gap > tolerance) | ~votes.isin(0, len(cols)), "INCONCLUSIVE")
        .when(votes == len(cols), "GAIN").otherwise("NO GAIN"))
    return table.withColumn("spread", gap).withColumn("verdict", verdict)


def behavior_recovery(df: DataFrame, by: list[str], c: Cols = PITCH) -> DataFrame:
    """Target = behaviour: every weight is one and IPS, SNIPS return the observed mean."""
    same = logged(df.withColumn("pi", F.col("mu")), c=c)
    return estimates(same, by, c).join(
        same.groupBy(*by).agg(F.max(F.abs(F.col("w") - 1)).alias("max_weight_error")), by)


def relog_known(df: DataFrame, seed: int, noise: float, c: Cols = PITCH) -> DataFrame:
    """Logged states with actions redrawn from the known `mu` and rewards from the known `q`.

    The true value of any target is then the mean of sum(pi * q), which `logged` adds as `v_hat`.
    """
    u = hashing.uniform(seed, c.row, lane=0)
    e = hashing.uniform(seed, c.row, lane=1) - 0.5
    rows = df.withColumn("_u", u)
    running = F.transform(F.sequence(F.lit(1), F.lit(len(FAMILIES))),
                          lambda i: total(F.slice("mu", 1, i)))
    # the last cell takes the rounding remainder
    place = F.least(F.size(F.filter(running, lambda s: s <= F.col("_u"))), F.lit(len(FAMILIES) - 1))
    names = F.array(*[F.lit(f) for f in FAMILIES])
    rows = rows.withColumn("_place", place + 1)
    return rows.withColumns({
        c.action: F.element_at(names, F.col("_place")),
        c.reward: F.element_at("q", F.col("_place")) + F.lit(noise) * e,
    }).drop("_u", "_place")


def overlap_filter(df: DataFrame, floor: float) -> DataFrame:
    """States in which behaviour gives at least `floor` to every action the target uses."""
    pairs = F.arrays_zip(F.col("pi"), F.col("mu"))
    return df.filter(F.forall(pairs, lambda z: (z["pi"] <= 0) | (z["mu"] >= F.lit(floor))))


def placebo(df: DataFrame, column: str, c: Cols = PITCH) -> DataFrame:
    """Reward replaced by something fixed before the decision; q becomes its overall mean."""
    mean = df.agg(F.avg(column)).scalar()
    return (df.withColumn(c.reward, F.col(column).cast("double")).withColumn("_m", mean)
            .withColumn("q", F.transform("q", lambda x: F.col("_m"))).drop("_m"))


def perturb(df: DataFrame, zs=(-1.0, 0.0, 1.0)) -> DataFrame:
    """The reward model moved by z standard errors, one copy of the rows per z."""
    moved = df.withColumn("z", F.explode(F.array(*[F.lit(float(z)) for z in zs])))
    return moved.withColumn("q", F.zip_with("q", "q_sd", lambda q, s: q + F.col("z") * s))


def myopic_vs_full(myopic: DataFrame, full: DataFrame, on: list[str]) -> DataFrame:
    """Bandit and full-episode results next to each other (one row per policy)."""
    return myopic.join(full, on, "full_outer")


def propensity_specs(df: DataFrame, specs: dict[str, str], by: list[str], cap: float | None = None,
                     c: Cols = PITCH) -> DataFrame:
    """The same estimates under several behaviour models; `specs` maps a name to its column."""
    out = None
    for name, col in specs.items():
        one = estimates(logged(df.withColumn("mu", F.col(col)), cap, c), by, c)
        one = one.withColumn("spec", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
