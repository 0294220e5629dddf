"""Queries over sections F (tables and policies) and I: target policies and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from throughline.config import FAMILIES
from throughline.functions.arrays import dot, normalise
from throughline.operators import ope, policy, tables
from throughline.plans.common import STUDY, Query, r6, rounded, spread
from throughline.plans.metric_queries import B, CLUSTER, QALL, Q_SQL, boot
from throughline.plans.oracle import r6 as q6, sql, uniform
from throughline.session import stage
from throughline.plans.study import (
    STUDY_SQL, VIEW_LEVELS, chain_sql, study_rows, train_and_held, with_probs, with_views,
)

K = STUDY.shrink
DRAWS = 200
BETA = 0.001
TEMPERATURE = 0.01
#: Decisions that an action shares with its state where a policy is chosen freely.
PRIOR = 1.0
SEED = STUDY.seed
ALPHA = ["alpha"]


def _bandit(train: DataFrame) -> DataFrame:
    """One row per count: q, its uncertainty, and the uncertainty-aware target."""
    q = tables.value_table(train, ["count_state"], K)
    return q.join(policy.bandit_policy(q, ["count_state"], DRAWS, SEED), "count_state")


def _targeted(train: DataFrame, held: DataFrame, mu: str = "mu") -> DataFrame:
    """Held-out rows with behaviour, reward model and the feasible target."""
    return _aimed(with_probs(held, train, VIEW_LEVELS["C"], mu), train, _bandit(train).select("count_state", "target"), mu)


def _aimed(rows: DataFrame, train: DataFrame, targets: DataFrame, mu: str = "mu") -> DataFrame:
    """`rows` with the reward model and a state's target kept to what is feasible; behaviour in states without one."""
    valued = tables.with_values(rows, tables.state_values(train, ["count_state"], K), ["count_state"], K)
    none = F.array(*[F.lit(False) for _ in FAMILIES])
    return valued.join(targets, "count_state", "left").withColumn("target", F.coalesce(policy.restrict(
        F.col("target"), F.coalesce("feasible", none), F.col(mu)), F.col(mu)))


def _mixed(rows: DataFrame, alphas=STUDY.alphas) -> DataFrame:
    out = rows.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    return out.withColumn("pi", policy.mix_policy(F.col("mu"), F.col("target"), F.col("alpha")))


def _logged(spark, path, alphas=STUDY.alphas, cap=STUDY.weight_cap) -> DataFrame:
    train, held = train_and_held(spark, path)
    return ope.logged(_mixed(_targeted(train, held), alphas), cap)


def _state_policies(train: DataFrame) -> DataFrame:
    """Per count and alpha: the mixture of overall behaviour at that count and the target."""
    mu = tables.eb_selection(train, [["count_state"]], K).select(
        "count_state", normalise(F.col("probs")).alias("mu"))
    return _mixed(mu.join(_bandit(train), "count_state"))


def bandit_policy(spark, path):
    t = _bandit(train_and_held(spark, path)[0])
    return t.select("count_state", *spread("q", "q"), *spread("q_sd", "sd"), *spread("target", "target"))


def mix_policy(spark, path):
    train, held = train_and_held(spark, path)
    return _mixed(_targeted(train, held), [0.25]).select("row_id", *spread("pi", "pi"))


def transitions(spark, path):
    return rounded(policy.transitions(train_and_held(spark, path)[0]), "sum_reward")


def mdp_value(spark, path):
    trans = policy.transitions(train_and_held(spark, path)[0])
    behaviour = policy.mdp_value(trans).withColumnRenamed("v", "v_behavior")
    greedy = policy.greedy_value(trans, PRIOR).withColumnRenamed("v", "v_greedy")
    return rounded(behaviour.join(greedy, "state"), "v_behavior", "v_greedy")


def fqe(spark, path):
    return rounded(_fqe_table(train_and_held(spark, path)[0]), "pi", "q")


def _fqe_table(train: DataFrame, by: tuple[str, ...] = ("alpha",), policies: DataFrame | None = None,
               trans: DataFrame | None = None) -> DataFrame:
    rows = _state_policies(train) if policies is None else policies
    pi = F.array(*[F.struct(F.lit(a).alias("action"), F.col("pi")[i].alias("pi"))
                   for i, a in enumerate(FAMILIES)])
    cells = rows.select(*by, F.col("count_state").alias("state"), F.inline(pi))
    return policy.fqe(policy.transitions(train) if trans is None else trans, cells, list(by), PRIOR)


def conservative_q(spark, path):
    t = policy.conservative_q(policy.transitions(train_and_held(spark, path)[0]), BETA, PRIOR)
    return rounded(t, "mu", "q", "q_conservative")


EST = ["observed", "dm", "ips", "snips", "dr"]


def ope_table(spark, path):
    return rounded(ope.estimates(_logged(spark, path), ALPHA), *EST)


def stepwise_dr(spark, path):
    return rounded(ope.stepwise_dr(_logged(spark, path), ALPHA), "stepwise_dr")


def fqe_value(spark, path):
    train, held = train_and_held(spark, path)
    return rounded(ope.fqe_value(held.filter("pitch_number = 1"), _fqe_table(train), ALPHA), "fqe")


def ope_diagnostics(spark, path):
    t = ope.ope_diagnostics(_logged(spark, path, cap=None), ALPHA, STUDY.support_floor, STUDY.rare_floor)
    return rounded(t, "ess", "max_weight", "q99_weight", "oos_support_frac", "rare_action_frac")


def policy_distance(spark, path):
    return rounded(ope.policy_distance(_logged(spark, path), ALPHA), "kl_from_behavior", "tv_from_behavior")


def value_interval(spark, path):
    t = ope.value_interval(_logged(spark, path), ALPHA, CLUSTER, B, SEED)
    return rounded(t, "value", "lower_95", "lo", "hi")


def ope_verdict(spark, path):
    train, held = train_and_held(spark, path)
    per = ope.episode_estimates(_logged(spark, path), ALPHA)
    fq = ope.fqe_value(held.filter("pitch_number = 1"), _fqe_table(train), ALPHA)
    t = ope.agreement_verdict(per.join(fq, "alpha"), STUDY.tolerance)
    return rounded(t, "observed", "dm", "dr", "fqe", "spread")


def behavior_recovery(spark, path):
    train, held = train_and_held(spark, path)
    return rounded(ope.behavior_recovery(_targeted(train, held), ["season"]), *EST, "max_weight_error")


def relog_known(spark, path):
    """A logged bandit with known answers. The reward model is the truth here, so the direct
    method gives the true value and the weighted estimators have to meet it."""
    train, held = train_and_held(spark, path)
    rows = ope.logged(_mixed(ope.relog_known(_targeted(train, held), SEED, 0.1)))
    t = ope.estimates(rows, ALPHA)
    return rounded(t.withColumn("true_value", F.col("dm")), *EST, "true_value")


#: Estimators whose self-tests open the gate; the direct method is only as good as its reward model.
GATE = ["ips", "snips", "dr"]


def _self_tests(train: DataFrame, held: DataFrame) -> DataFrame:
    """Behaviour's own value from behaviour's log, and known values of all mixtures from a log with known rewards.

    In the second one the reward model is fitted to the log, as it would be without knowing the truth.
    """
    rows = _targeted(train, held)
    same = ope.logged(_mixed(rows, [0.0]))
    own = ope.estimator_intervals(same, ALPHA, F.col("reward"), CLUSTER, B, SEED).withColumn("test", F.lit("behavior"))
    known = ope.relog_known(rows, SEED, 0.1).withColumnRenamed("q", "q_true").drop("q_sd", "q_n")
    fitted = tables.with_values(known, tables.state_values(known, ["count_state"], K), ["count_state"], K)
    logged = ope.logged(_mixed(fitted))
    truth = ope.estimator_intervals(logged, ALPHA, dot(F.col("pi"), F.col("q_true")), CLUSTER, B, SEED).withColumn("test", F.lit("known"))
    return ope.self_tests(own.unionByName(truth))


def ope_self_tests(spark, path):
    t = _self_tests(*train_and_held(spark, path)).select("test", "alpha", "estimator", "truth", "value", "lo", "hi", "passed")
    return rounded(t, "truth", "value", "lo", "hi")


def policy_report(spark, path):
    """One row per mixture with everything a policy has to report; its verdict waits for the self-tests."""
    train, held = train_and_held(spark, path)
    rows = stage(_logged(spark, path).drop("w"), "logged")
    free = ope.logged(rows)
    rows = ope.logged(rows, STUDY.weight_cap)
    per = ope.episode_estimates(rows, ALPHA).join(ope.fqe_value(held.filter("pitch_number = 1"), _fqe_table(train), ALPHA), "alpha")
    value = ope.value_interval(rows, ALPHA, CLUSTER, B, SEED).select("alpha", "value", "lower_95")
    mean = rows.groupBy("alpha").agg(F.avg("reward").alias("observed_decision"))
    out = (per.join(value, "alpha").join(mean, "alpha")
           .join(ope.ope_diagnostics(free, ALPHA, STUDY.support_floor, STUDY.rare_floor), "alpha")
           .join(ope.policy_distance(rows, ALPHA), "alpha"))
    tests = stage(_self_tests(train, held), "self-tests").filter(F.col("estimator").isin(GATE))
    gate = tests.agg(F.coalesce(F.bool_and("passed"), F.lit(False))).scalar()
    t = ope.gated_verdict(out.withColumn("gate_open", gate), STUDY.tolerance)
    return rounded(t, "observed", "dm", "dr", "fqe", "spread", "value", "lower_95", "observed_decision", "ess", "max_weight", "q99_weight",
                   "oos_support_frac", "rare_action_frac", "kl_from_behavior", "tv_from_behavior")


def overlap_filter(spark, path):
    rows = ope.overlap_filter(_logged(spark, path), 0.05)
    return rounded(ope.estimates(rows, ALPHA), *EST)


def placebo(spark, path):
    train, held = train_and_held(spark, path)
    rows = ope.logged(ope.placebo(_mixed(_targeted(train, held)), "score_diff_pitcher"), STUDY.weight_cap)
    t = ope.estimates(rows, ALPHA).withColumn("effect", F.col("dr") - F.col("observed"))
    return rounded(t, *EST, "effect")


def perturb(spark, path):
    train, held = train_and_held(spark, path)
    rows = ope.logged(ope.perturb(_mixed(_targeted(train, held), [0.5])), STUDY.weight_cap)
    return rounded(ope.estimates(rows, ["z"]), *EST)


def myopic_vs_full(spark, path):
    """The bandit's target (one decision ahead) beside the policy read off the conservative values (the whole episode)."""
    train, held = train_and_held(spark, path)
    by = ["policy", "alpha"]
    # a row per pair of states and action, which two policies and both rounds of values read
    trans = stage(policy.transitions(train), "transitions")
    aimed, full = [], []
    mu = tables.eb_selection(train, [["count_state"]], K).select("count_state", normalise(F.col("probs")).alias("mu"))
    for name, targets in {"bandit": _bandit(train).select("count_state", "target"), "conservative": _conservative(trans)}.items():
        rows = _aimed(with_probs(held, train, VIEW_LEVELS["C"], "mu"), train, targets)
        aimed.append(rows.withColumn("policy", F.lit(name)))
        states = mu.join(targets, "count_state", "left").withColumn("target", F.coalesce("target", "mu"))
        full.append(_mixed(states).withColumn("policy", F.lit(name)))
    q = _fqe_table(train, ("policy", "alpha"), full[0].unionByName(full[1]), trans)
    t = ope.mixture_episodes(aimed[0].unionByName(aimed[1]), STUDY.alphas, policy.mix_policy, ["policy"], STUDY.weight_cap)
    t = t.join(ope.fqe_value(held.filter("pitch_number = 1"), q, by), by)
    return rounded(t, "observed", "dm", "dr", "stepwise_dr", "fqe")


def _conservative(trans: DataFrame) -> DataFrame:
    return policy.conservative_policy(policy.conservative_q(trans, BETA, PRIOR), "count_state", TEMPERATURE)


def conservative_policy(spark, path):
    return _conservative(policy.transitions(train_and_held(spark, path)[0])).select("count_state", *spread("target", "target"))


SPECS = {"count_pitcher": "mu", "count": "mu_count", "count_pitcher_prev": "mu_prev"}


def propensity_specs(spark, path):
    train, held = train_and_held(spark, path)
    rows = with_views(_targeted(train, held), train,
                      {"mu_count": [["count_state"]], "mu_prev": VIEW_LEVELS["L1"]})
    rows = rows.withColumn("pi", policy.mix_policy(F.col("mu"), F.col("target"), 0.5))
    return rounded(ope.propensity_specs(rows, SPECS, ["season"], STUDY.weight_cap), *EST)


def episode_reward(spark, path):
    """Observed episode value on all seasons, by split label: what every policy is held to."""
    rows = study_rows(spark, path).filter("reward IS NOT NULL")
    per = rows.groupBy("season", "pa_id").agg(F.sum("reward").alias("_g"))
    return per.groupBy("season").agg(F.count("*").alias("n_episodes"), r6(F.avg("_g")).alias("mean_return"))


# ---------------------------------------------------------------- SQL side

LOW = [f.lower() for f in FAMILIES]
BANDIT_SQL = f"""draws AS (SELECT q.*, d, {uniform(SEED, 'count_state', 'fam', 'd', lane=0)} AS u0, {uniform(SEED, 'count_state', 'fam', 'd', lane=1)} AS u1
  FROM q CROSS JOIN (SELECT unnest(range(1, {DRAWS + 1})) AS d) WHERE fam <> 'XX'),
best AS (SELECT count_state, d, arg_max(fam, q + q_sd*(sqrt(-2*ln(greatest(u0, 1/4294967296.0::DOUBLE)))*cos(6.283185307179586::DOUBLE*u1))) AS fam FROM draws GROUP BY 1,2),
bandit AS (SELECT q.count_state, q.fi, q.fam, any_value(q.q) AS q, any_value(q.q_sd) AS q_sd, count(b.d)/{DRAWS} AS target
  FROM q LEFT JOIN best b ON b.count_state=q.count_state AND b.fam=q.fam GROUP BY 1,2,3)"""
def target_sql(targets: str = "bandit", out: str = "pt") -> str:
    return f"""{out}l AS (SELECT h.*, m.fi, m.fam, m.p AS mu, t.target, b.q, b.q_sd,
    coalesce(CASE m.fam {' '.join(f"WHEN '{f}' THEN ok_{f.lower()}" for f in FAMILIES)} END, false) AS ok
  FROM held h JOIN vc m ON m.count_state=h.count_state AND m.pitcher=h.pitcher JOIN qall b ON b.count_state=h.count_state AND b.fam=m.fam
    LEFT JOIN {targets} t ON t.count_state=h.count_state AND t.fam=m.fam),
{out} AS (SELECT *, CASE WHEN mass>0 THEN (CASE WHEN ok THEN target ELSE 0 END)/mass ELSE mu END AS tilde
  FROM (SELECT *, sum(CASE WHEN ok THEN target ELSE 0 END) OVER (PARTITION BY row_id) AS mass FROM {out}l))"""


BASE = [STUDY_SQL, Q_SQL, chain_sql("vc", VIEW_LEVELS["C"]), BANDIT_SQL, QALL, target_sql()]


def mixed_sql(alphas=STUDY.alphas, src: str = "pt", out: str = "pm") -> str:
    return (f"{out} AS (SELECT *, (1-alpha)*mu + alpha*tilde AS pi FROM {src} "
            f"CROSS JOIN (SELECT unnest([{','.join(f'{a}::DOUBLE' for a in alphas)}]) AS alpha))")


def logged_sql(by: list[str], src: str = "pm", cap: float | None = STUDY.weight_cap, out: str = "lg",
               reward: str = "reward", q: str = "q", extra: str = "") -> str:
    w = "max(CASE WHEN fam=family THEN pi/mu END)"
    w = w if cap is None else f"least({w}, {cap})"
    return (f"{out} AS (SELECT {', '.join(by)}, row_id, any_value(pa_id) AS pa_id, any_value(pitch_number) AS pitch_number, "
            f"any_value(pitcher) AS pitcher, any_value(game_pk) AS game_pk, any_value({reward}) AS r, sum(pi*{q}) AS v_hat, {w} AS w, "
            f"max(CASE WHEN fam=family THEN {q} END) AS q_a, sum(CASE WHEN pi>0 THEN pi*ln(pi/mu) ELSE 0 END) AS kl, sum(abs(pi-mu))/2 AS tv, "
            f"max(CASE WHEN pi>0 AND mu<{STUDY.support_floor} THEN 1 ELSE 0 END) AS oos, sum(CASE WHEN mu<{STUDY.rare_floor} THEN pi ELSE 0 END) AS rare, "
            f"max(CASE WHEN pi>0 AND mu<0.05 THEN 1 ELSE 0 END) AS thin{extra} FROM {src} WHERE {reward} IS NOT NULL GROUP BY {', '.join(by)}, row_id)")


def est_sql(by: str, src: str = "lg", extra: str = "", where: str = "") -> str:
    return (f"SELECT {by}, count(*) AS n, {q6('avg(r)')} AS observed, {q6('avg(v_hat)')} AS dm, {q6('avg(w*r)')} AS ips, "
            f"{q6('sum(w*r)/sum(w)')} AS snips, {q6('avg(v_hat+w*(r-q_a))')} AS dr{extra} FROM {src} {where} GROUP BY {by.split(' AS ')[-1]}")


LOGGED = [*BASE, mixed_sql(), logged_sql(ALPHA)]

TRANS = """tr AS (SELECT count_state AS state, family AS action, coalesce(lead(count_state) OVER w, 'end') AS next_state, reward
  FROM train WINDOW w AS (PARTITION BY pa_id ORDER BY pitch_number)),
trn AS (SELECT state, action, next_state, count(*) AS n, count(reward) AS n_reward, coalesce(sum(reward),0) AS sum_reward FROM tr GROUP BY 1,2,3),
steps AS (SELECT state, action, next_state, n/na AS prob, r, na/ns AS mu FROM trn
  JOIN (SELECT state, action, sum(n) AS na, coalesce(sum(sum_reward)/nullif(sum(n_reward),0),0) AS r FROM trn GROUP BY 1,2) USING (state, action)
  JOIN (SELECT state, sum(n) AS ns FROM trn GROUP BY 1) USING (state))"""


PRIORED = f"""stepsk AS (SELECT c.state, c.action, w.next_state, (coalesce(t.n,0) + {PRIOR}::DOUBLE*w.nw/c.ns)/(c.na + {PRIOR}) AS prob, c.r, c.na/c.ns AS mu
  FROM (SELECT state, action, na, r, sum(na) OVER (PARTITION BY state) AS ns FROM (
      SELECT state, action, sum(n) AS na, coalesce(sum(sum_reward)/nullif(sum(n_reward),0),0) AS r FROM trn GROUP BY 1,2)) c
  JOIN (SELECT state, next_state, sum(n) AS nw FROM trn GROUP BY 1,2) w USING (state) LEFT JOIN trn t ON t.state=c.state AND t.action=c.action AND t.next_state=w.next_state)"""
#: Rounds of the check's own value iteration, with which every value stands still.
CHECK_ROUNDS = 600


def fixed_point_sql(name: str, choose: str, steps: str, by: list[str] = []) -> str:
    """`<name>v`, `<name>q`: values and qualities after so many rounds."""
    g = ", ".join([*by, "state"])
    pre = ", ".join(f"s.{x}" for x in [*by, "state", "action"])
    on = " AND ".join([f"v.{b}=s.{b}" for b in by] + ["v.state=s.next_state"])
    quality = lambda v: f"SELECT {pre}, s.mu, s.pi, s.r + sum(s.prob*coalesce(v.v,0)) AS q FROM {steps} s LEFT JOIN {v} v ON {on} GROUP BY {pre}, s.mu, s.pi, s.r"
    return f"""{name}r AS (SELECT DISTINCT 0 AS round, {g}, 0.0::DOUBLE AS v FROM {steps} UNION ALL
  SELECT round + 1, {g}, v FROM (SELECT any_value((SELECT max(round) FROM {name}r)) AS round, {g}, {choose} AS v FROM ({quality(name + 'r')}) GROUP BY {g}) WHERE round < {CHECK_ROUNDS}),
{name}v AS (SELECT * FROM {name}r WHERE round={CHECK_ROUNDS}),
{name}q AS ({quality(name + 'v')})"""


EXPECTED = "coalesce(sum(pi*q)/nullif(sum(pi),0),0)"
STEPS_B = "stepsb AS (SELECT *, mu AS pi FROM steps)"
STEPS_K = "stepskb AS (SELECT *, mu AS pi FROM stepsk)"
POLICIES = [chain_sql("mc", [["count_state"]], K, "train"), f"""sp AS (SELECT mc.count_state AS state, mc.fam AS action, alpha, (1-alpha)*p + alpha*target AS pi
  FROM mc JOIN bandit b ON b.count_state=mc.count_state AND b.fam=mc.fam CROSS JOIN (SELECT unnest([{','.join(f'{a}::DOUBLE' for a in STUDY.alphas)}]) AS alpha)),
stepsp AS (SELECT s.*, a.alpha, CASE WHEN k.state IS NULL THEN s.mu ELSE coalesce(sp.pi, 0) END AS pi FROM stepsk s CROSS JOIN (SELECT DISTINCT alpha FROM sp) a
  LEFT JOIN sp ON sp.state=s.state AND sp.action=s.action AND sp.alpha=a.alpha LEFT JOIN (SELECT DISTINCT state FROM sp) k ON k.state=s.state)"""]
FQE = [STUDY_SQL, Q_SQL, BANDIT_SQL, TRANS, PRIORED, *POLICIES, fixed_point_sql("fx", EXPECTED, "stepsp", ALPHA)]
FQE_VALUE = f"""fv AS (SELECT alpha, sum(n*v)/sum(n) AS fqe FROM (SELECT count_state AS state, count(*) AS n FROM held WHERE pitch_number=1 GROUP BY 1)
  JOIN (SELECT alpha, state, sum(pi*q)/sum(pi) AS v FROM fxq GROUP BY 1,2) USING (state) GROUP BY 1)"""
CONSERVATIVE = [STUDY_SQL, TRANS, PRIORED, STEPS_K, fixed_point_sql("c", f"max(q - {BETA}*(1/mu - 1)) FILTER (action<>'XX')", "stepskb"),
    f"""conservative AS (SELECT state AS count_state, fam, coalesce(w,0)/sum(w) OVER (PARTITION BY state) AS target FROM (SELECT DISTINCT state FROM cq) s CROSS JOIN fams
  LEFT JOIN (SELECT state, action AS fam, mu*exp((c - max(c) OVER (PARTITION BY state))/{TEMPERATURE}) AS w
    FROM (SELECT *, q - {BETA}*(1/mu - 1) AS c FROM cq WHERE action<>'XX')) x USING (state, fam))"""]
STEPWISE = """sw AS (SELECT alpha, count(*) AS n_episodes, avg(v) AS stepwise_dr FROM (
  SELECT alpha, pa_id, sum(coalesce(wp,1)*v_hat + coalesce(wp,1)*w*(r-q_a)) AS v FROM (
    SELECT *, product(w) OVER (PARTITION BY alpha, pa_id ORDER BY pitch_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wp FROM lg)
  GROUP BY 1,2) GROUP BY 1)"""
PER_PA = "pp AS (SELECT alpha, sum(r)/count(DISTINCT pa_id) AS observed, sum(v_hat)/count(DISTINCT pa_id) AS dm, sum(v_hat+w*(r-q_a))/count(DISTINCT pa_id) AS dr FROM lg GROUP BY 1)"
ROUND = lambda *xs: ", ".join(f"{q6(x)} AS {x}" for x in xs)

RELOG = f"""cum AS (SELECT *, sum(mu) OVER (PARTITION BY alpha, row_id ORDER BY fi ROWS UNBOUNDED PRECEDING) AS s,
    {uniform(SEED, 'row_id', lane=0)} AS u, {uniform(SEED, 'row_id', lane=1)} - 0.5 AS e FROM pm),
pick AS (SELECT alpha, row_id, 1 + least(count(*) FILTER (s <= u), 7) AS k FROM cum GROUP BY 1,2),
re2 AS (SELECT c.* EXCLUDE (family, reward), pick.k, (SELECT any_value(fam) FROM fams WHERE fi=pick.k) AS family,
    max(CASE WHEN fi=pick.k THEN q END) OVER (PARTITION BY alpha, row_id) + 0.1*e AS reward FROM cum c JOIN pick USING (alpha, row_id))"""


QHAT = f"""hm AS (SELECT avg(reward) AS m FROM known WHERE alpha=0 AND fi=1),
hf AS (SELECT f.fi, f.fam, (coalesce(sum(k.reward),0)+{K}*any_value(m))/(count(k.reward)+{K}) AS q FROM fams f CROSS JOIN hm LEFT JOIN (SELECT * FROM known WHERE alpha=0 AND fi=1) k ON k.family=f.fam GROUP BY 1,2),
hq AS (SELECT s.count_state, hf.fam, (coalesce(sum(k.reward),0)+{K}*any_value(hf.q))/(count(k.reward)+{K}) AS qh
  FROM (SELECT DISTINCT count_state FROM known) s CROSS JOIN hf LEFT JOIN (SELECT * FROM known WHERE alpha=0 AND fi=1) k ON k.count_state=s.count_state AND k.family=hf.fam GROUP BY 1,2)"""


def _tests_ctes() -> list[str]:
    """`tests`: one row per test, mixture and estimator, unrounded."""
    def one(name: str, src: str, truth: str) -> list[str]:
        sums = {"n": "1.0::DOUBLE", "t": truth, "dm": "v_hat", "ips": "w*r", "sw": "w", "dr": "v_hat+w*(r-q_a)"}
        values = {"dm": "{x}.dm/{x}.n", "ips": "{x}.ips/{x}.n", "snips": "{x}.ips/{x}.sw", "dr": "{x}.dr/{x}.n"}
        point = f"SELECT alpha, count(*)::DOUBLE AS n, {', '.join(f'sum({v}) AS {k}' for k, v in sums.items() if k != 'n')} FROM {src} GROUP BY 1"
        each = " UNION ALL ".join(
            f"SELECT '{name}' AS test, p.alpha, '{k}' AS estimator, any_value(p.t/p.n) AS truth, any_value({v.format(x='p')}) AS value, "
            f"quantile_cont({v.format(x='b')}, 0.025) AS lo, quantile_cont({v.format(x='b')}, 0.975) AS hi "
            f"FROM b_{name} b JOIN p_{name} p USING (alpha) WHERE b.n > 0 AND b.sw > 0 GROUP BY p.alpha" for k, v in values.items())
        return [f"b_{name} AS ({boot(src, ALPHA, CLUSTER, sums)})", f"p_{name} AS ({point})", f"e_{name} AS ({each})"]

    return [RELOG.replace("re2 AS", "known AS"), QHAT, "kq AS (SELECT * FROM known JOIN hq USING (count_state, fam))",
            logged_sql(ALPHA, "kq", None, out="lk", q="qh", extra=", sum(pi*q) AS truth"),
            "pn AS (SELECT * FROM pm WHERE alpha=0)", logged_sql(ALPHA, "pn", None, out="ln0"),
            *one("behavior", "ln0", "r"), *one("known", "lk", "truth"),
            "tests AS (SELECT *, lo - 1e-9 <= truth AND truth <= hi + 1e-9 AS passed FROM (SELECT * FROM e_behavior UNION ALL SELECT * FROM e_known))"]


def _report_sql() -> str:
    inconclusive = (f"NOT gate_open OR greatest(dm,dr,fqe)-least(dm,dr,fqe) > {STUDY.tolerance} OR (dm>observed)::INT+(dr>observed)::INT+(fqe>observed)::INT NOT IN (0,3)")
    fields = ROUND("observed", "dm", "dr", "fqe", "value", "lower_95", "observed_decision", "ess", "max_weight", "q99_weight",
                   "oos_support_frac", "rare_action_frac", "kl_from_behavior", "tv_from_behavior")
    return sql(f"""SELECT alpha, n, {fields}, {q6('greatest(dm,dr,fqe)-least(dm,dr,fqe)')} AS spread, gate_open,
  CASE WHEN {inconclusive} THEN 'INCONCLUSIVE' WHEN dm>observed AND lower_95>observed_decision THEN 'GAIN' ELSE 'NO GAIN' END AS verdict
FROM pp JOIN fv USING (alpha) JOIN vi USING (alpha) JOIN dg USING (alpha) JOIN ds USING (alpha),
  (SELECT coalesce(bool_and(passed), false) AS gate_open FROM tests WHERE estimator IN ('ips','snips','dr'))""",
               *LOGGED, PER_PA, *FQE[3:], FQE_VALUE, *_tests_ctes(), logged_sql(ALPHA, cap=None, out="lf"),
               "vp AS (SELECT alpha, avg(v_hat+w*(r-q_a)) AS value, avg(r) AS observed_decision FROM lg GROUP BY 1)",
               f"vb AS ({boot('lg', ALPHA, CLUSTER, {'n': '1.0::DOUBLE', 's': 'v_hat+w*(r-q_a)'})})",
               "vi AS (SELECT alpha, any_value(value) AS value, any_value(observed_decision) AS observed_decision, quantile_cont(s/n, 0.05) AS lower_95 FROM vb JOIN vp USING (alpha) WHERE n>0 GROUP BY 1)",
               "dg AS (SELECT alpha, count(*) AS n, sum(w)*sum(w)/sum(w*w) AS ess, max(w) AS max_weight, quantile_disc(w, 0.99) AS q99_weight, avg(oos) AS oos_support_frac, avg(rare) AS rare_action_frac FROM lf GROUP BY 1)",
               "ds AS (SELECT alpha, avg(kl) AS kl_from_behavior, avg(tv) AS tv_from_behavior FROM lg GROUP BY 1)")


def _myopic_sql() -> str:
    alphas = f"(SELECT unnest([{','.join(f'{a}::DOUBLE' for a in STUDY.alphas)}]) AS alpha)"
    by = ["policy", "alpha"]
    return sql(f"SELECT policy, alpha, {ROUND('observed', 'dm', 'dr')}, n_episodes, {ROUND('stepwise_dr', 'fqe')} FROM pp2 JOIN sw2 USING (policy, alpha) JOIN fv2 USING (policy, alpha)",
               *BASE, *CONSERVATIVE[1:], target_sql("conservative", "pc"),
               "p2 AS (SELECT *, 'bandit' AS policy FROM pt UNION ALL BY NAME SELECT *, 'conservative' AS policy FROM pc)",
               mixed_sql(src="p2", out="pm2"), logged_sql(by, "pm2", out="lg2"),
               PER_PA.replace("pp AS (SELECT alpha", "pp2 AS (SELECT policy, alpha").replace("FROM lg GROUP BY 1", "FROM lg2 GROUP BY 1, 2"),
               STEPWISE.replace("sw AS (SELECT alpha", "sw2 AS (SELECT policy, alpha").replace("SELECT alpha, pa_id", "SELECT policy, alpha, pa_id").replace(
                   "PARTITION BY alpha", "PARTITION BY policy, alpha").replace("FROM lg)", "FROM lg2)").replace("GROUP BY 1,2) GROUP BY 1)", "GROUP BY 1,2,3) GROUP BY 1,2)"),
               POLICIES[0], f"""sp2 AS (SELECT mc.count_state AS state, mc.fam AS action, policy, alpha, (1-alpha)*p + alpha*coalesce(target, p) AS pi
  FROM mc JOIN {alphas} ON true JOIN (SELECT unnest(['bandit', 'conservative']) AS policy) ON true
  LEFT JOIN (SELECT count_state, fam, target, 'bandit' AS policy FROM bandit UNION ALL SELECT count_state, fam, target, 'conservative' FROM conservative) t USING (count_state, fam, policy)),
stepsp2 AS (SELECT s.*, policy, alpha, coalesce(sp2.pi, 0) AS pi FROM stepsk s JOIN sp2 USING (state, action))""",
               fixed_point_sql("f2", EXPECTED, "stepsp2", by),
               FQE_VALUE.replace("fv AS (SELECT alpha", "fv2 AS (SELECT policy, alpha").replace("SELECT alpha, state", "SELECT policy, alpha, state").replace(
                   "FROM fxq GROUP BY 1,2)", "FROM f2q GROUP BY 1,2,3)").replace("GROUP BY 1)", "GROUP BY 1, 2)", 2).replace("held WHERE pitch_number=1 GROUP BY 1, 2)", "held WHERE pitch_number=1 GROUP BY 1)"))


QUERIES = {
    "bandit_policy": Query(bandit_policy, sql(
        "SELECT count_state, " + ", ".join(f"{q6(f'max(CASE WHEN fam={chr(39)}{f}{chr(39)} THEN {c} END)')} AS {p}_{f.lower()}"
                                          for c, p in (("q", "q"), ("q_sd", "sd"), ("target", "target")) for f in FAMILIES)
        + " FROM bandit GROUP BY 1", STUDY_SQL, Q_SQL, BANDIT_SQL)),
    "mix_policy": Query(mix_policy, sql(
        "SELECT row_id, " + ", ".join(f"{q6(f'max(CASE WHEN fam={chr(39)}{f}{chr(39)} THEN pi END)')} AS pi_{f.lower()}" for f in FAMILIES)
        + " FROM pm GROUP BY 1", *BASE, mixed_sql([0.25]))),
    "transitions": Query(transitions, sql(
        f"SELECT state, action, next_state, n, n_reward, {q6('sum_reward')} AS sum_reward FROM trn", STUDY_SQL, TRANS)),
    "mdp_value": Query(mdp_value, sql(
        f"SELECT state, {q6('b.v')} AS v_behavior, {q6('g.v')} AS v_greedy, action FROM bv b JOIN gv g USING (state) "
        f"JOIN (SELECT state, arg_max(action, q) AS action FROM gq WHERE action<>'XX' GROUP BY 1) USING (state)",
        STUDY_SQL, TRANS, PRIORED, STEPS_B, STEPS_K, fixed_point_sql("b", EXPECTED, "stepsb"),
        fixed_point_sql("g", "max(q) FILTER (action<>'XX')", "stepskb"))),
    "fqe": Query(fqe, sql(f"SELECT alpha, state, action, {ROUND('pi', 'q')} FROM fxq", *FQE)),
    "conservative_q": Query(conservative_q, sql(
        f"SELECT state, action, {ROUND('mu', 'q')}, {q6(f'q - {BETA}*(1/mu - 1)')} AS q_conservative FROM cq", *CONSERVATIVE[:-1])),
    "conservative_policy": Query(conservative_policy, sql(
        "SELECT count_state, " + ", ".join(f"{q6(f'max(CASE WHEN fam={chr(39)}{f}{chr(39)} THEN target END)')} AS target_{f.lower()}" for f in FAMILIES)
        + " FROM conservative GROUP BY 1", *CONSERVATIVE)),
    "ope_table": Query(ope_table, sql(est_sql("alpha"), *LOGGED)),
    "stepwise_dr": Query(stepwise_dr, sql(f"SELECT alpha, n_episodes, {ROUND('stepwise_dr')} FROM sw", *LOGGED, STEPWISE)),
    "fqe_value": Query(fqe_value, sql(f"SELECT alpha, {ROUND('fqe')} FROM fv", *FQE, FQE_VALUE)),
    "ope_diagnostics": Query(ope_diagnostics, sql(
        f"SELECT alpha, count(*) AS n, {q6('sum(w)*sum(w)/sum(w*w)')} AS ess, {q6('max(w)')} AS max_weight, {q6('quantile_disc(w, 0.99)')} AS q99_weight, "
        f"{q6('avg(oos)')} AS oos_support_frac, {q6('avg(rare)')} AS rare_action_frac FROM lg GROUP BY 1",
        *BASE, mixed_sql(), logged_sql(ALPHA, cap=None))),
    "policy_distance": Query(policy_distance, sql(
        f"SELECT alpha, {q6('avg(kl)')} AS kl_from_behavior, {q6('avg(tv)')} AS tv_from_behavior FROM lg GROUP BY 1", *LOGGED)),
    "value_interval": Query(value_interval, sql(
        f"SELECT alpha, {q6('any_value(value)')} AS value, {q6('quantile_cont(s/n, 0.05)')} AS lower_95, {q6('quantile_cont(s/n, 0.025)')} AS lo, {q6('quantile_cont(s/n, 0.975)')} AS hi "
        f"FROM ({boot('lg', ALPHA, CLUSTER, {'n': '1.0::DOUBLE', 's': 'v_hat+w*(r-q_a)'})}) JOIN (SELECT alpha, avg(v_hat+w*(r-q_a)) AS value FROM lg GROUP BY 1) USING (alpha) WHERE n>0 GROUP BY 1", *LOGGED)),
    "ope_verdict": Query(ope_verdict, sql(f"""
SELECT alpha, {ROUND('observed', 'dm', 'dr', 'fqe')}, {q6('greatest(dm,dr,fqe)-least(dm,dr,fqe)')} AS spread,
  CASE WHEN greatest(dm,dr,fqe)-least(dm,dr,fqe) > {STUDY.tolerance} OR (dm>observed)::INT+(dr>observed)::INT+(fqe>observed)::INT NOT IN (0,3) THEN 'INCONCLUSIVE'
    WHEN dm>observed THEN 'GAIN' ELSE 'NO GAIN' END AS verdict
FROM pp JOIN fv USING (alpha)""", *LOGGED, PER_PA, *FQE[3:], FQE_VALUE)),
    "behavior_recovery": Query(behavior_recovery, sql(
        est_sql("season", extra=f", {q6('max(abs(w-1))')} AS max_weight_error"),
        *BASE, "pb AS (SELECT *, mu AS pi FROM pt)", logged_sql(["season"], "pb", None))),
    "relog_known": Query(relog_known, sql(
        est_sql("alpha", extra=f", {q6('avg(v_hat)')} AS true_value"), *BASE, mixed_sql(), RELOG, logged_sql(ALPHA, "re2", None))),
    "ope_self_tests": Query(ope_self_tests, sql(
        f"SELECT test, alpha, estimator, {ROUND('truth', 'value', 'lo', 'hi')}, passed FROM tests", *BASE, mixed_sql(), *_tests_ctes())),
    "policy_report": Query(policy_report, _report_sql()),
    "overlap_filter": Query(overlap_filter, sql(est_sql("alpha", where="WHERE thin=0"), *LOGGED)),
    "placebo": Query(placebo, sql(
        est_sql("alpha", extra=f", {q6('avg(v_hat+w*(r-q_a)) - avg(r)')} AS effect"), *BASE, mixed_sql(),
        "pz AS (SELECT *, (SELECT avg(score_diff_pitcher) FROM held) AS qz FROM pm)",
        logged_sql(ALPHA, "pz", reward="score_diff_pitcher", q="qz"))),
    "perturb": Query(perturb, sql(
        est_sql("z"), *BASE, mixed_sql([0.5]),
        "pz AS (SELECT *, q + z*q_sd AS qz FROM pm CROSS JOIN (SELECT unnest([-1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE]) AS z))",
        logged_sql(["z"], "pz", q="qz"))),
    "myopic_vs_full": Query(myopic_vs_full, _myopic_sql()),
    "propensity_specs": Query(propensity_specs, sql(
        " UNION ALL ".join(est_sql("season", f"lg_{n}", f", '{n}' AS spec") for n in SPECS),
        *BASE, chain_sql("mc", [["count_state"]], K), chain_sql("ml", VIEW_LEVELS["L1"]), mixed_sql([0.5]),
        "px AS (SELECT pm.* EXCLUDE (mu), pm.mu AS mu0, mc.p AS mu1, ml.p AS mu2 FROM pm JOIN mc ON mc.count_state=pm.count_state AND mc.fam=pm.fam "
        "JOIN ml ON ml.count_state=pm.count_state AND ml.pitcher=pm.pitcher AND ml.prev_family=pm.prev_family AND ml.fam=pm.fam)",
        *[f"px{i} AS (SELECT *, mu{i} AS mu FROM px)" for i in range(3)],
        *[logged_sql(["season"], f"px{i}", out=f"lg_{n}") for i, n in enumerate(SPECS)])),
    "episode_reward": Query(episode_reward, sql(
        f"SELECT season, count(*) AS n_episodes, {q6('avg(g)')} AS mean_return FROM (SELECT season, pa_id, sum(reward) AS g FROM study WHERE reward IS NOT NULL GROUP BY 1,2) GROUP BY 1", STUDY_SQL)),
}
