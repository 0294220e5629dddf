from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from throughline.config import FAMILIES, Study
from throughline.functions import arrays, hashing
from throughline.operators import crossfit, decision, eventtree, falsify, metrics, ope, policy, predictability, tables
from throughline.plans.study import study_rows

UNIFORM = [0.125] * 8


def onehot(i, rest=0.0):
    return [1.0 if j == i else rest for j in range(8)]


def preds(spark, rows):
    return spark.createDataFrame(rows, "row_id long, family string, action_probs array<double>")


def test_scores_by_hand(spark):
    p = [0.5, 0.3, 0.2, 0.0, 0.0, 0.0, 0.0, 0.0]
    df = preds(spark, [(1, "FF", p), (2, "SI", p), (3, "FC", p)])
    got = {r.row_id: r for r in metrics.scored(df).collect()}
    assert got[1].loss == pytest.approx(-math.log(0.5))
    assert got[2].brier == pytest.approx(0.25 + 0.49 + 0.04)
    assert [got[i].rank for i in (1, 2, 3)] == [1, 2, 3]
    f1 = metrics.macro_f1(df, []).first()
    assert f1.n_classes == 3 and f1.macro_f1 == pytest.approx((0.5 + 0 + 0) / 3)
    # a certain miss scores the floor, not infinity
    miss = preds(spark, [(1, "XX", p)])
    assert metrics.log_loss(miss, []).first().log_loss == pytest.approx(-math.log(metrics.EPS))


def test_contract(spark):
    ok = metrics.conform(preds(spark, [(1, "FF", UNIFORM)]).withColumns(
        {"state_view": F.lit("C"), "model_id": F.lit("m")}))
    metrics.assert_valid(ok)
    with pytest.raises(decision.ContractError):
        metrics.assert_valid(ok.unionByName(ok))
    with pytest.raises(decision.ContractError):
        metrics.assert_valid(ok.withColumn("action_probs", F.array(F.lit(0.4))))


def test_quantiles_are_exact(spark):
    """Equal to the sorted values, with ties, few and many values, and groups of any size; nulls don't count."""
    rng = random.Random(6)
    rows = [("a", rng.randrange(40) / 7) for _ in range(1001)] + [("b", rng.random()) for _ in range(333)] + [("c", 1.5), ("c", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    asked = [(1, 10), (1, 2), (9, 10), (99, 100), (1, 1)]
    got = {(r.g, r.quantile): r.value for r in metrics.quantiles(df, "x", asked, ["g"]).collect()}
    for g in "abc":
        values = sorted(x for k, x in rows if k == g and x is not None)
        for at, (num, den) in enumerate(asked):
            assert got.pop((g, at)) == values[max(1, -(-len(values) * num // den)) - 1]
    assert not got
    whole = sorted(x for _, x in rows if x is not None)
    assert [r.value for r in metrics.quantiles(df, "x", [(1, 2)]).collect()] == [whole[-(-len(whole) // 2) - 1]]


def test_decile_cuts_and_calibration(spark):
    df = spark.range(1000).withColumn("propensity", F.col("id") / 1000.0)
    cuts = df.withColumn("c", metrics.decile_cuts(df, "propensity")).first().c
    assert cuts == [i / 1000 for i in range(99, 999, 100)]
    t = metrics.calibration(preds(spark, [(1, "FF", onehot(0))]), 10, []).orderBy("bin").collect()
    assert [(r.bin, r.n, r.observed) for r in t] == [(0, 7, 0.0), (9, 1, 1.0)]


def test_poisson_weights_have_mean_and_variance_one(spark):
    w = hashing.poisson_one(hashing.uniform(1, "id"))
    got = spark.range(40_000).agg(F.avg(w).alias("m"), F.variance(w).alias("v")).first()
    assert got.m == pytest.approx(1.0, abs=0.02) and got.v == pytest.approx(1.0, abs=0.04)


def test_draws_do_not_depend_on_partitioning(spark):
    df = spark.range(500).withColumn("u", hashing.uniform(7, "id"))
    other = spark.range(500).repartition(13).withColumn("u", hashing.uniform(7, "id"))
    assert df.exceptAll(other).isEmpty()


def test_frontier(spark):
    m = spark.createDataFrame([("a", 1.0, 5), ("b", 2.0, 5), ("c", 3.0, 9)], "model_id string, v double, cost int")
    assert {r.model_id for r in metrics.compute_frontier(m, "v", "cost").collect()} == {"b", "c"}


def test_shrink_chain_by_hand(spark):
    rows = [("a", "FF")] * 3 + [("a", "SI")] + [("b", "SI")] * 4
    train = spark.createDataFrame(rows, "ctx string, family string")
    contexts = spark.createDataFrame([("a",), ("new",)], "ctx string")
    got = {r.ctx: r for r in tables.eb_lookup(train, contexts, [["ctx"]], 2.0).collect()}
    root = (3 + 1 / 8) / 9  # eight rows, and one spread over eight families
    assert got["a"].probs[0] == pytest.approx((3 + 2 * root) / 6)
    assert got["new"].probs[0] == pytest.approx(root) and got["new"].n == 0
    for r in got.values():
        assert sum(r.probs) == pytest.approx(1.0)


def test_markov_depth_zero_is_the_base_rate(spark, sf):
    rows = study_rows(spark, sf)
    t = tables.markov_backoff(rows, 1, 50.0).filter("depth = 0")
    n = rows.count()
    base = {r.family: r["count"] / n for r in rows.groupBy("family").count().collect()}
    for r in t.collect():
        assert r.p == pytest.approx((base.get(r.action, 0.0) * n + 1 / 8) / (n + 1)) and r.p > 0


# ---------------------------------------------------------------- off-policy evaluation

LOGGED = "row_id long, pa_id long, pitch_number int, pitcher long, family string, reward double, mu array<double>, pi array<double>, q array<double>"


def two_step(spark):
    """(v_hat, w, R, q) = (0.1, 1.5, 0.2, 0.05), (0.3, 0.5, -0.1, 0.2): stepwise DR is 0.55."""
    return spark.createDataFrame(
        [(1, 1, 0.1, 1.5, 0.2, 0.05), (1, 2, 0.3, 0.5, -0.1, 0.2)],
        "pa_id long, pitch_number int, v_hat double, w double, reward double, q_a double")


def test_stepwise_dr_by_hand(spark):
    assert ope.stepwise_dr(two_step(spark), []).first().stepwise_dr == pytest.approx(0.55)


def test_target_equal_to_behaviour(spark):
    rows = [(i, i, 1, 1, FAMILIES[i % 8], i / 10, UNIFORM, UNIFORM, [0.1] * 8) for i in range(20)]
    df = ope.logged(spark.createDataFrame(rows, LOGGED))
    mean = sum(i / 10 for i in range(20)) / 20
    got = ope.estimates(df, []).first()
    assert got.ips == pytest.approx(mean) and got.snips == pytest.approx(mean)
    d = ope.ope_diagnostics(df, [], 0.01, 0.05).first()
    assert d.ess == pytest.approx(20) and d.max_weight == pytest.approx(1.0)
    dist = ope.policy_distance(df, []).first()
    assert dist.kl_from_behavior == pytest.approx(0) and dist.tv_from_behavior == pytest.approx(0)


def test_weights_are_clipped(spark):
    mu = [0.01] + [0.99 / 7] * 7
    df = spark.createDataFrame([(1, 1, 1, 1, "FF", 1.0, mu, onehot(0), [0.0] * 8)], LOGGED)
    assert ope.logged(df).first().w == pytest.approx(100.0)
    assert ope.logged(df, 20.0).first().w == 20.0
    assert ope.overlap_filter(df, 0.05).count() == 0


def test_estimators_recover_a_known_value(spark):
    """A logged bandit with known behaviour and known rewards."""
    mu = [0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05]
    pi = [0.05, 0.05, 0.1, 0.1, 0.1, 0.1, 0.2, 0.3]
    q = [0.01 * i for i in range(8)]
    truth = sum(p * v for p, v in zip(pi, q))
    base = spark.range(20_000).select(
        F.col("id").alias("row_id"), F.col("id").alias("pa_id"), F.lit(1).alias("pitch_number"),
        (F.col("id") % 50).alias("pitcher"), F.lit("FF").alias("family"), F.lit(0.0).alias("reward"),
        *[F.array(*[F.lit(x) for x in v]).alias(n) for n, v in (("mu", mu), ("pi", pi), ("q", q))])
    rows = ope.relog_known(base, 11, 0.02)
    share = rows.filter("family = 'FF'").count() / 20_000
    assert share == pytest.approx(0.3, abs=0.015)
    wrong_q = rows.withColumn("q", F.array(*[F.lit(0.0)] * 8))
    for df, names in ((rows, ("dm", "ips", "snips", "dr")), (wrong_q, ("ips", "snips", "dr"))):
        got = ope.estimates(ope.logged(df), []).first()
        for n in names:
            assert got[n] == pytest.approx(truth, abs=0.004), n
    ci = ope.value_interval(ope.logged(rows).withColumn("g", F.lit(1)), ["g"], ["pitcher"], 50, 3).first()
    assert ci.lo <= truth <= ci.hi and ci.lo <= ci.lower_95 <= ci.value


def test_verdicts(spark):
    rows = [("same", 0.0, 0.010, 0.011, 0.012), ("far", 0.0, 0.01, 0.2, 0.01),
            ("sign", 0.0, 0.001, -0.001, 0.001), ("worse", 0.1, 0.010, 0.011, 0.012)]
    df = spark.createDataFrame(rows, "p string, observed double, dm double, dr double, fqe double")
    got = {r.p: r.verdict for r in ope.agreement_verdict(df, 0.005).collect()}
    assert got == {"same": "GAIN", "far": "INCONCLUSIVE", "sign": "INCONCLUSIVE", "worse": "NO GAIN"}


def test_gain_needs_an_open_gate_and_a_lower_bound(spark):
    rows = [("gain", 0.0, 0.010, 0.011, 0.012, 0.002, 0.001, True), ("closed", 0.0, 0.010, 0.011, 0.012, 0.002, 0.001, False),
            ("unsure", 0.0, 0.010, 0.011, 0.012, 0.0005, 0.001, True), ("apart", 0.0, 0.010, 0.2, 0.012, 0.002, 0.001, True),
            ("loss", 0.1, 0.010, 0.011, 0.012, 0.002, 0.001, True)]
    df = spark.createDataFrame(rows, "p string, observed double, dm double, dr double, fqe double, lower_95 double, observed_decision double, gate_open boolean")
    got = {r.p: r.verdict for r in ope.gated_verdict(df, 0.005).collect()}
    assert got == {"gain": "GAIN", "closed": "INCONCLUSIVE", "unsure": "NO GAIN", "apart": "INCONCLUSIVE", "loss": "NO GAIN"}


def test_intervals_find_a_known_truth_and_miss_a_false_one(spark):
    mu, q = [0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05], [0.01 * i for i in range(8)]
    base = spark.range(6000).select(
        F.col("id").alias("row_id"), F.col("id").alias("pa_id"), F.lit(1).alias("pitch_number"), (F.col("id") % 60).alias("pitcher"),
        F.lit("FF").alias("family"), F.lit(0.0).alias("reward"),
        *[F.array(*[F.lit(x) for x in v]).alias(n) for n, v in (("mu", mu), ("pi", UNIFORM), ("q", q))])
    rows = ope.logged(ope.relog_known(base, 11, 0.02).withColumn("a", F.lit(1)))
    t = {r.estimator: r for r in ope.self_tests(ope.estimator_intervals(rows, ["a"], arrays.dot(F.col("pi"), F.col("q")), ["pitcher"], 100, 3)).collect()}
    assert set(t) == {"dm", "ips", "snips", "dr"} and all(r.passed for r in t.values())
    off = ope.self_tests(ope.estimator_intervals(rows, ["a"], F.lit(9.0), ["pitcher"], 20, 3))
    assert off.filter("passed").isEmpty()


def test_restrict_and_mix(spark):
    df = spark.createDataFrame([([0.5, 0.5] + [0.0] * 6, [True] + [False] * 7, UNIFORM),
                                ([0.5, 0.5] + [0.0] * 6, [False] * 8, UNIFORM)],
                               "t array<double>, ok array<boolean>, mu array<double>")
    got = df.select(policy.restrict(F.col("t"), F.col("ok"), F.col("mu")).alias("r")).collect()
    assert got[0].r == onehot(0) and got[1].r == UNIFORM
    mixed = df.select(policy.mix_policy(F.col("mu"), F.col("t"), 0.25).alias("m")).first().m
    assert sum(mixed) == pytest.approx(1.0) and mixed[0] == pytest.approx(0.75 / 8 + 0.125)


def test_backward_values_by_hand(spark):
    """s0 -a-> s1 (reward 1), s1 -a-> end (reward 2): values 3 and 2."""
    t = spark.createDataFrame([("s0", "FF", "s1", 2, 2, 2.0), ("s1", "FF", "end", 1, 1, 2.0)],
                              "state string, action string, next_state string, n long, n_reward long, sum_reward double")
    assert {r.state: r.v for r in policy.mdp_value(t).collect()} == {"s0": 3.0, "s1": 2.0}
    g = {r.state: (r.v, r.action) for r in policy.greedy_value(t).collect()}
    assert g["s0"] == (3.0, "FF")


def test_values_of_a_loop_stand_still(spark):
    """A state that is left with probability 1/4 and pays 1 a step is worth 4; one that is never left has no value."""
    schema = "state string, action string, next_state string, n long, n_reward long, sum_reward double"
    t = spark.createDataFrame([("s", "FF", "s", 3, 3, 3.0), ("s", "FF", "end", 1, 1, 1.0)], schema)
    assert policy.mdp_value(t).first().v == pytest.approx(4.0, abs=1e-8)
    # an action seen only to go on shares a decision with its state and so comes to an end
    more = t.unionByName(spark.createDataFrame([("s", "SL", "s", 2, 2, 4.0)], schema))
    assert policy.greedy_value(more).first().action == "SL"
    with pytest.raises(policy.NoFixedPoint):
        policy._fixed_point(policy._with_policy(policy._steps(spark.createDataFrame([("s", "FF", "s", 1, 1, 1.0)], schema)), None, []),
                            policy.FOLLOW, [], limit=256)


@pytest.mark.parametrize("choice", [policy.FOLLOW, policy.Choice(lambda get: 0.001 / get("mu"), best=True)])
def test_rounds_in_rows_equal_rounds_by_joins(spark, choice):
    t = spark.createDataFrame([(s, a, n, 3 * (n == "end") + 1, 4, x) for s in "pq" for a, x in (("FF", 0.2), ("SL", 0.9)) for n in ("p", "q", "end")],
                              "state string, action string, next_state string, n long, n_reward long, sum_reward double")
    steps = policy._with_policy(policy._steps(t, 1.0), None, []).withColumn("k", F.lit(1))
    q, v = zip(*[[{tuple(r[:-1]): r[-1] for r in t.select("state", *(["action"] if i == 0 else []), "qv"[i]).collect()} for i, t in enumerate(
        policy._fixed_point(steps, choice, ["k"], 1e-6, few=few))] for few in (0, 20_000)])
    assert q[0] == pytest.approx(q[1], abs=1e-5) and v[0] == pytest.approx(v[1], abs=1e-5)


def test_behaviour_is_worth_its_episodes(spark):
    """Where the policy is behaviour, the value at the episodes' starts is their mean return, to the last episode's end."""
    rows = study_rows(spark, "/root/testdata/sf0.01").withColumn("reward", F.coalesce("reward", F.lit(0.0)))
    q = policy.fqe(policy.transitions(rows))
    mean = rows.agg((F.sum("reward") / F.countDistinct("pa_id")).alias("m")).first().m
    assert ope.fqe_value(rows.filter("pitch_number = 1"), q, []).first().fqe == pytest.approx(mean, abs=1e-7)


def test_conservative_policy_stays_with_behaviour(spark):
    q = spark.createDataFrame([("s", "FF", 0.9, 0.0, 0.0), ("s", "SL", 0.05, 0.1, 0.05), ("s", "XX", 0.05, 9.0, 9.0)],
                              "state string, action string, mu double, q double, q_conservative double")
    cold, warm = (policy.conservative_policy(q, "s", x).first().target for x in (0.001, 1e6))
    assert cold[FAMILIES.index("SL")] == pytest.approx(1.0) and warm[0] == pytest.approx(0.9 / 0.95, abs=1e-5)
    assert cold[-1] == warm[-1] == warm[1] == 0.0 and sum(warm) == pytest.approx(1.0)


def test_conservative_q_penalises_rare_actions(spark):
    t = spark.createDataFrame([("s", "FF", "end", 99, 99, 0.0), ("s", "SL", "end", 1, 1, 0.05)],
                              "state string, action string, next_state string, n long, n_reward long, sum_reward double")
    got = {r.action: r for r in policy.conservative_q(t, 0.001).collect()}
    assert got["SL"].q > got["FF"].q and got["SL"].q_conservative < got["FF"].q_conservative


# ---------------------------------------------------------------- falsification

def test_permutation_keeps_the_histories(spark, sf):
    rows = study_rows(spark, sf)
    fields = ["history_text", "multiset"]
    p = falsify.permute_history(rows, fields, 5)
    assert p.filter("multiset <> donor_multiset").isEmpty()
    assert p.select("history_text").exceptAll(p.select(F.col("donor_history_text"))).isEmpty()
    assert p.count() == rows.filter("pitch_number >= 2").count()
    q = falsify.pseudo_history(rows, ["history_text"], 5)
    assert q.filter("donor_id = row_id").isEmpty()


def test_split_strata_still_permute_whole(spark, sf):
    """The width of the buckets that split a stratum changes no donor; nothing is lost or doubled."""
    rows = study_rows(spark, sf)
    p = falsify.pseudo_history(rows, ["history_text"], 5, width=1)
    donors = [{(r.row_id, r.donor_id) for r in falsify.pseudo_history(rows, ["history_text"], 5, width=w).collect()} for w in (0, 1, 3)]
    assert donors[0] == donors[1] == donors[2]
    assert p.count() == rows.filter("pitch_number >= 2").count()
    given = p.select(F.coalesce("donor_id", "row_id").alias("row_id"))
    assert given.distinct().count() == p.count()


def test_planted_worlds(spark):
    rows = study_rows(spark, "/root/testdata/sf0.01")
    null = falsify.speed_gap_slope(falsify.plant_null(rows, 3), []).first()
    positive = falsify.speed_gap_slope(falsify.plant_effect(rows, 0.004, 3), []).first()
    assert abs(null.slope) < 0.0004
    assert positive.slope == pytest.approx(0.004, abs=0.0004)


def test_pvalues_of_fitted_models(spark):
    """The reward model's gain survives no exchange in the positive world. (One null world says nothing: see the next test.)"""
    from throughline.plans import falsify_queries
    got = {r.statistic: r for r in falsify_queries.permutation_pvalue(spark, "/root/testdata/sf0.01").collect()}
    assert got["effect"].p_value == pytest.approx(1 / 200) and got["effect"].observed_gain > got["effect"].mean_permuted_gain
    assert abs(got["null"].observed_gain) < 1e-4 and {r.rounds for r in got.values()} == {199}


def test_pvalues_are_calibrated(spark):
    """Over many worlds without an effect, small p-values are as rare as they should be; with one, all are small."""
    rng, worlds, rounds = random.Random(8), 60, 39
    rows = [(i, i % 90, 2, rng.random(), *[rng.gauss(0, 1) for _ in range(worlds)]) for i in range(450)]
    names = [f"w{j}" for j in range(worlds)]
    df = spark.createDataFrame(rows, "row_id long, k int, pitch_number int, y double, " + ", ".join(f"{n} double" for n in names))
    df = df.withColumn("effect", F.col("w0") + 2 * F.col("y"))
    terms = {n: (lambda own, donor, n=n: own[n] * donor["y"]) for n in [*names, "effect"]}
    sums = falsify.shifted_sums(df, [*names, "effect"], ["y"], terms, rounds, 4, ["k"])
    got = {r.statistic: r.p_value for r in falsify.permutation_pvalue(sums, [*names, "effect"]).collect()}
    assert got.pop("effect") == pytest.approx(1 / (rounds + 1))
    p = list(got.values())
    # 60 draws with a chance of 0.05 or 0.5: outside of these bounds in less than one of a thousand cases
    assert sum(x <= 0.05 for x in p) <= 10 and 17 <= sum(x <= 0.5 for x in p) <= 43


def test_shifted_sums_equal_donors_by_hand(spark):
    """One order serves all rounds; strata that are dealt out in parts give the same sums as whole ones."""
    rng = random.Random(3)
    rows = [(i, rng.choice("aaab") if i % 7 else f"own{i}", 1 + i % 4, rng.random(), rng.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "row_id long, k string, pitch_number int, x double, y double").repartition(5)
    strata = {}
    for i, k, t, x, y in rows:
        if t >= 2:
            strata.setdefault(k, []).append((hashlib.md5(f"9|{i}".encode()).hexdigest(), i, x, y))
    expected = [0.0] * 31
    for k, members in strata.items():
        members.sort()
        u = int(hashlib.md5(f"9|{k}".encode()).hexdigest()[:8], 16) / 2**32
        for r in range(31):
            places = int((r * u - math.floor(r * u)) * min(len(members), 31))
            expected[r] += sum(m[2] * members[(p + places) % len(members)][3] for p, m in enumerate(members))
    for block in (4096, 100):
        got = falsify.shifted_sums(df, ["x"], ["y"], {"s": lambda own, donor: own["x"] * donor["y"]}, 30, 9, ["k"], block).collect()
        assert {r.round: r.s for r in got} == pytest.approx(dict(enumerate(expected)))
        assert {r.n for r in got} == {sum(map(len, strata.values()))}


def test_histories_of_others_in_the_forecast(spark, sf):
    rows = study_rows(spark, sf)
    swapped = falsify.counterfactual(rows, ["history_text", "multiset"], 5)
    assert swapped.count() == rows.count()
    assert swapped.filter("pitch_number = 1 and (donor_id is not null or donor_history_text <> history_text)").isEmpty()
    both = falsify.own_and_donor(swapped, ["multiset", "history_text"], ["history_text"], ["family"])
    assert [r.n for r in both.groupBy("donor").agg(F.sum("n").alias("n")).collect()] == [rows.count()] * 2


def test_gaps_collapse_where_there_is_no_order(spark):
    """On first decisions own and donor histories are the same; C never reads one; U reads only what H2 keeps."""
    from throughline.plans import falsify_queries
    got = {(r.slice, r.state_view): r for r in falsify_queries.permuted_losses(spark, "/root/testdata/sf0.01").collect()}
    for (part, view), r in got.items():
        if part == "first_pitch" or view in ("C", "U"):
            assert r.gap == r.gap_lo == r.gap_hi == 0.0, (part, view)
    assert got["seq_eligible", "O"].moved > 0 and got["seq_eligible", "O"].loss_donor != got["seq_eligible", "O"].loss_own


# ---------------------------------------------------------------- predictability

def test_bits_are_zero_for_equal_forecasts(spark):
    df = preds(spark, [(1, "FF", UNIFORM), (2, "SI", UNIFORM)])
    assert predictability.bits_seq(df, "action_probs", "action_probs", []).first().bits == 0.0
    sharp = df.withColumn("o", F.array(*[F.lit(0.25)] * 4, *[F.lit(0.0)] * 4))
    assert predictability.bits_seq(sharp, "o", "action_probs", []).first().bits == pytest.approx(1.0)


def test_game_value_by_hand(spark):
    """Matching pennies on two actions has value 0; always playing one of them loses 1."""
    a, b = [1.0, -1.0] + [-9.0] * 6, [-1.0, 1.0] + [-9.0] * 6
    half = [0.5, 0.5] + [0.0] * 6
    pay = spark.createDataFrame([("s", a, b)], "s string, payoff_swing array<double>, payoff_take array<double>")
    pol = spark.createDataFrame([("s", "mixed", half), ("s", "pure", onehot(0))],
                                "s string, name string, policy_probs array<double>")
    got = {r.name: r for r in predictability.exploitability(pol, pay, ["s"], 400).collect()}
    assert got["mixed"].game_lower <= 0 <= got["mixed"].game_upper
    assert got["mixed"].exploitability == pytest.approx(0.0, abs=0.06)
    assert got["pure"].exploitability == pytest.approx(1.0, abs=0.06)


def test_array_helpers(spark):
    row = spark.createDataFrame([([0.5, 0.5], [0.25, 0.75])], "p array<double>, q array<double>").select(
        arrays.entropy_ratio(F.col("p"), F.col("q")).alias("kl"),
        arrays.variation(F.col("p"), F.col("q")).alias("tv"),
        arrays.dot(F.col("p"), F.col("q")).alias("d")).first()
    assert row.kl == pytest.approx(0.5 * math.log(2) + 0.5 * math.log(2 / 3))
    assert row.tv == pytest.approx(0.25) and row.d == pytest.approx(0.5)
    assert Study().seed == 20260713


def test_order_adds_nothing_before_the_first_decision(spark, sf):
    """On first decisions U, L1 and O know the same, so their losses are the same."""
    from throughline.plans.study import view_losses
    r = view_losses(spark, sf).filter("pitch_number = 1").agg(
        F.max(F.abs(F.col("loss_u") - F.col("loss_o"))).alias("u"), F.max(F.abs(F.col("loss_l1") - F.col("loss_o"))).alias("l1")).first()
    assert r.u < 1e-9 and r.l1 < 1e-9


def test_actions_unseen_in_training_have_a_probability(spark):
    train = spark.createDataFrame([("a", "FF"), ("a", "SI")], "k string, family string")
    seen = spark.createDataFrame([("a",), ("b",)], "k string")
    for r in tables.eb_lookup(train, seen, [["k"]], 50.0).collect():
        assert min(r.probs) > 0 and abs(sum(r.probs) - 1) < 1e-9


def _oof_rows(spark, moved=()):
    """A log of 40 clusters; those in `moved` have other actions and rewards."""
    rows = []
    for g in range(40):
        for i in range(6):
            draw = random.Random(f"{g}-{i}-{g in moved}")
            reward = None if draw.random() < 0.1 else draw.uniform(-1, 1)
            rows.append((g * 6 + i, g, "0-0" if i % 2 else None, FAMILIES[draw.randrange(4)], reward))
    df = spark.createDataFrame(rows, "row_id long, game long, count_state string, family string, reward double")
    return crossfit.with_fold(df, 4, 7, ["game"])


def _by_row(df):
    return {r.row_id: (r.fold, list(r.mu), list(r.q)) for r in df.collect()}


def test_no_cluster_trains_its_own_score(spark):
    """Other actions and rewards of a fold leave its own scores as they were, and move those of the other folds."""
    plain = _oof_rows(spark)
    folds = {r.game: r.fold for r in plain.select("game", "fold").distinct().collect()}
    assert len(folds) == 40     # a cluster lies in one fold
    before = _by_row(crossfit.out_of_fold_tables(plain, ["count_state"], 10.0))
    after = _by_row(crossfit.out_of_fold_tables(_oof_rows(spark, {g for g, f in folds.items() if f == 1}), ["count_state"], 10.0))
    assert len(before) == len(after) == 240
    for row, (fold, mu, q) in before.items():
        assert sum(mu) == pytest.approx(1) and min(mu) > 0
        same = mu == pytest.approx(after[row][1], abs=1e-12) and q == pytest.approx(after[row][2], abs=1e-12)
        assert same == (fold == 1)


def test_leaving_a_fold_out_is_a_fit_on_the_others(spark):
    """Subtracted counts against counts of the other folds' rows, in plain loops."""
    rows, k = _oof_rows(spark), 10.0
    log, got = rows.collect(), _by_row(crossfit.out_of_fold_tables(rows, ["count_state"], 10.0))
    for r in log:
        rest = [x for x in log if x.fold != r.fold]
        near = [x for x in rest if x.count_state == r.count_state]
        paid = [x.reward for x in rest if x.reward is not None]
        for i, a in enumerate(FAMILIES):
            root = (sum(x.family == a for x in rest) + 1 / 8) / (len(rest) + 1)
            assert got[r.row_id][1][i] == pytest.approx((sum(x.family == a for x in near) + k * root) / (len(near) + k))
            far = [x.reward for x in rest if x.family == a and x.reward is not None]
            own = [x.reward for x in near if x.family == a and x.reward is not None]
            mean = (sum(far) + k * sum(paid) / len(paid)) / (len(far) + k)
            assert got[r.row_id][2][i] == pytest.approx((sum(own) + k * mean) / (len(own) + k))


def test_out_of_fold_tables_of_nothing_and_of_one_fold(spark):
    rows = _oof_rows(spark)
    assert crossfit.out_of_fold_tables(rows.limit(0), ["count_state"], 10.0).count() == 0
    alone = crossfit.out_of_fold_tables(rows.withColumn("fold", F.lit(0)), ["count_state"], 10.0).first()
    assert list(alone.mu) == pytest.approx([1 / 8] * 8) and list(alone.q) == pytest.approx([0.0] * 8)
    audit = crossfit.fold_audit(rows.withColumn("fold", F.col("row_id").cast("int") % 2), ["game"]).collect()
    assert [(r.n_clusters, r.n_shared) for r in audit] == [(40, 40), (40, 40)]     # a bad fold is seen


def _pitches(spark, rows):
    """(count_state, family, leaf) as a log with node labels."""
    out = []
    for i, (state, family, leaf) in enumerate(rows):
        swing = leaf not in ("ball", "called_strike")
        contact = ("in_play" if leaf not in ("whiff", "foul") else leaf) if swing else None
        out.append((i, 2000, state, family, swing, None if swing else leaf == "called_strike", contact, leaf if contact == "in_play" else None))
    return spark.createDataFrame(out, "row_id long, season int, count_state string, family string, node_swing boolean, "
                                      "node_called_strike boolean, node_contact string, events string")


def test_event_tree_leaves_by_hand(spark):
    draw = random.Random(3)
    leaves = ["ball", "called_strike", "whiff", "foul", "single", "field_out"]
    log = [(draw.choice(["0-0", "1-2"]), draw.choice(["FF", "SL"]), draw.choice(leaves)) for _ in range(200)]
    train, k = _pitches(spark, log), 10.0
    contexts = spark.createDataFrame([("0-0", "FF"), ("0-0", "SL"), ("3-0", "CU")], "count_state string, family string")
    got = {}
    for r in eventtree.leaf_probabilities(train, contexts, [["count_state"], ["count_state", "family"]], k).collect():
        got.setdefault((r.count_state, r.family), {})[r.leaf] = r.p
    assert len(got) == 3

    def share(rows, of, hit, width):
        """Shares of `hit` among the rows that reach a node, from all of them to the context's own."""
        p = None
        for level in rows:
            reach = [x for x in level if of(x)]
            n = sum(map(hit, reach))
            p = (n + 1 / width) / (len(reach) + 1) if p is None else (n + k * p) / (len(reach) + k)
        return p

    swings, plays = leaves[2:], leaves[4:]
    for (state, family), dist in got.items():
        assert sum(dist.values()) == pytest.approx(1)
        assert set(dist) == {*leaves[:4], "in_play:single", "in_play:field_out", eventtree.UNSEEN}
        rows = [[x[2] for x in log], [x[2] for x in log if x[0] == state], [x[2] for x in log if x[:2] == (state, family)]]
        swing = share(rows, lambda x: True, lambda x: x in swings, 2)
        assert dist["ball"] == pytest.approx((1 - swing) * share(rows, lambda x: x not in swings, lambda x: x == "ball", 2))
        hit = share(rows, lambda x: x in swings, lambda x: x in plays, 3)
        assert dist["in_play:single"] == pytest.approx(swing * hit * share(rows, lambda x: x in plays, lambda x: x == "single", 3))
        assert dist["foul"] == pytest.approx(swing * share(rows, lambda x: x in swings, lambda x: x == "foul", 3))

    held = _pitches(spark, [("0-0", "FF", "ball"), ("0-0", "FF", "triple"), ("3-0", "CU", "single")])
    every = eventtree.leaf_probabilities(train, contexts, [["count_state"], ["count_state", "family"]], k)
    score = eventtree.final_event_scores(held, every, ["count_state", "family"], ["season"]).first()
    ff, cu = got["0-0", "FF"], got["3-0", "CU"]
    told = [(ff, "ball"), (ff, eventtree.UNSEEN), (cu, "in_play:single")]
    assert score.n == 3
    assert score.log_loss == pytest.approx(-sum(math.log(d[x]) for d, x in told) / 3)
    assert score.brier == pytest.approx(sum(sum((p - (y == x)) ** 2 for y, p in d.items()) for d, x in told) / 3)


def test_event_tree_of_nothing(spark):
    train = _pitches(spark, [("0-0", "FF", "ball")]).limit(0)
    contexts = spark.createDataFrame([("0-0", "FF")], "count_state string, family string")
    dist = {r.leaf: r.p for r in eventtree.leaf_probabilities(train, contexts, [["count_state", "family"]], 10.0).collect()}
    assert dist == pytest.approx({"ball": 1 / 4, "called_strike": 1 / 4, "whiff": 1 / 6, "foul": 1 / 6, eventtree.UNSEEN: 1 / 6})
