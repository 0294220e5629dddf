"""Queries over section G: scores, calibration, ablation, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from throughline.config import FAMILIES
from throughline.functions.hashing import POISSON_CUTS
from throughline.operators import decision, metrics, tables
from throughline.plans.common import STUDY, Query, r6, rounded
from throughline.plans.oracle import r6 as q6, sql, uniform
from throughline.plans.study import (
    STUDY_SQL, VIEW_LEVELS, chain_sql, pred_sql, predictions, sliced, train_and_held, view_losses,
    with_probs,
)
from throughline.plans.table_queries import E2

K = STUDY.shrink
CLUSTER = ["pitcher", "game_pk"]


def log_loss(spark, path):
    """The smallest full question: does the previous action help, by season and slice?"""
    train, held = train_and_held(spark, path)
    look = tables.first_order(train.filter("pitch_number >= 2"), K)
    held = held.filter("pitch_number >= 2")
    shares = tables.action_counts(train.filter("pitch_number >= 2"), [])
    base = shares.select(tables.root_shares(len(FAMILIES))).scalar()
    rows = held.join(look.select("prev_family", F.col("probs").alias("first_order")),
                     "prev_family", "left").withColumn("base", base)
    rows = rows.withColumn("first_order", F.coalesce("first_order", "base"))
    rows = decision.with_slices(rows)
    return rounded(rows.groupBy("season", "slice").agg(
        F.count("*").alias("n"),
        F.avg(metrics.log_loss_of(F.col("first_order"), F.col("family"))).alias("loss_first_order"),
        F.avg(metrics.log_loss_of(F.col("base"), F.col("family"))).alias("loss_base"),
    ), "loss_first_order", "loss_base")


BY = ["state_view", "season"]


def next_action_loss(spark, path):
    return rounded(metrics.log_loss(predictions(spark, path), BY), "log_loss")


def brier(spark, path):
    return rounded(metrics.brier(predictions(spark, path), BY), "brier")


def topk(spark, path):
    return rounded(metrics.topk_accuracy(predictions(spark, path), BY), "top1", "top2")


def macro_f1(spark, path):
    return rounded(metrics.macro_f1(predictions(spark, path), BY), "macro_f1")


def macro_micro(spark, path):
    rows = decision.low_history(metrics.scored(predictions(spark, path)), STUDY.min_history)
    return rounded(metrics.macro_micro(rows, ["state_view", "is_low_history"]), "micro", "macro")


def calibration(spark, path):
    breakouts = {"family": None, "count": F.col("count_state"), "hand": F.col("stand")}
    t = metrics.calibration_breakouts(predictions(spark, path), STUDY.bins, ["state_view"], breakouts)
    return rounded(t, "mean_p", "observed")


def skill(spark, path):
    train, held = train_and_held(spark, path)
    pred = with_probs(held, train, VIEW_LEVELS["L1"], "action_probs")
    own = tables.shrunk_pitcher_count(train, K).select("pitcher", "count_state", F.col("probs").alias("_own"))
    alike = tables.base_freq(train).select("count_state", "stand", "p_throws", F.col("probs").alias("_alike"))
    root = tables.action_counts(train, []).select(tables.root_shares(len(FAMILIES))).scalar()
    pred = (pred.join(own, ["pitcher", "count_state"], "left").join(alike, ["count_state", "stand", "p_throws"], "left")
            .withColumn("_root", root).withColumn("base_probs", F.coalesce("_own", "_alike", "_root")))
    return rounded(metrics.skill(pred, ["season"]), "skill")


def _valued(spark, path):
    train, held = train_and_held(spark, path)
    pred = with_probs(held, train, VIEW_LEVELS["C"], "action_probs")
    i = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family")).cast("int")
    return (tables.with_values(pred, tables.state_values(train, ["count_state"], K), ["count_state"], K)
            .withColumn("exp_reward", F.element_at("q", i))
            .withColumn("propensity", F.element_at("action_probs", i)))


def value_error(spark, path):
    return rounded(metrics.value_error(_valued(spark, path), ["season", "family"]), "mae", "rmse")


def value_calibration(spark, path):
    return rounded(metrics.value_calibration(_valued(spark, path), ["season"]), "intercept", "slope")


def reward_by_decile(spark, path):
    rows = _valued(spark, path).filter("reward is not null").withColumn("propensity", F.round("propensity", 9))
    return rounded(metrics.reward_by_action_decile(rows, metrics.decile_cuts(rows, "propensity")), "observed", "predicted")


NODES = {"swing": ("node_swing", ["true", "false"]), "called": ("node_called_strike", ["true", "false"]),
         "contact": ("node_contact", ["whiff", "foul", "in_play"])}
NODE_LEVELS = [["count_state"], ["count_state", "family"]]


def event_loss(spark, path):
    train, held = train_and_held(spark, path)
    for name, (label, alphabet) in NODES.items():
        text = {label: F.col(label).cast("string")}
        train, held = train.withColumns(text), held.withColumns(text)
        held = with_probs(held, train, NODE_LEVELS, f"{name}_probs", K, label, alphabet)
    return rounded(metrics.event_loss(held, NODES, ["season"]), "log_loss", "brier")


def ablation_delta(spark, path):
    rows = decision.with_slices(view_losses(spark, path))
    cols = [f"loss_{v.lower()}" for v in VIEW_LEVELS] + ["delta_order", "delta_matchup"]
    return rounded(metrics.ablation_delta(rows, ["slice"]), *cols)


B = STUDY.replicates


def cluster_bootstrap(spark, path):
    """Interval of the mean loss per view, by game and by actor only."""
    rows = metrics.scored(predictions(spark, path))
    parts = []
    for name, cluster in {"pitcher_game": CLUSTER, "pitcher": ["pitcher"]}.items():
        reps = metrics.bootstrap(rows, cluster, {"n": F.lit(1.0), "s": F.col("loss")},
                                 ["state_view"], B, STUDY.seed)
        reps = reps.filter("n > 0").withColumn("v", F.col("s") / F.col("n"))
        parts.append(metrics.interval(reps, ["state_view"], "v").withColumn("cluster", F.lit(name)))
    return rounded(parts[0].unionByName(parts[1]), "value", "lo", "hi")


def delta_intervals(spark, path):
    t = metrics.delta_intervals(decision.with_slices(view_losses(spark, path)), CLUSTER, ["slice"],
                                B, STUDY.seed)
    return rounded(t, "delta_order", "order_lo", "order_hi", "delta_matchup", "matchup_lo", "matchup_hi")


def validate_predictions(spark, path):
    return metrics.validate(metrics.conform(predictions(spark, path)))


def harness(spark, path):
    t = metrics.harness(predictions(spark, path), B, STUDY.seed, CLUSTER)
    return rounded(t, "value", "lo", "hi")


def compute_frontier(spark, path):
    """Loss against the number of cells a table model has to hold, over the five views."""
    train, _ = train_and_held(spark, path)
    losses = view_losses(spark, path).agg(*[F.avg(f"loss_{v.lower()}").alias(v) for v in VIEW_LEVELS])
    models = losses.unpivot([], list(VIEW_LEVELS), "model_id", "loss")
    cells = None
    for v, levels in VIEW_LEVELS.items():
        one = train.select(*levels[-1]).distinct().agg(
            F.lit(v).alias("model_id"), F.count("*").alias("n_params"))
        cells = one if cells is None else cells.unionByName(one)
    table = models.join(cells, "model_id").withColumn("value", -F.col("loss"))
    return metrics.compute_frontier(table, "value", "n_params").select(
        "model_id", "n_params", r6("loss").alias("loss"))


# ---------------------------------------------------------------- SQL side

PRED = [STUDY_SQL, pred_sql()]
ALL_VIEWS = list(VIEW_LEVELS)
LOSSES = [STUDY_SQL, pred_sql(ALL_VIEWS), f"""losses AS (
  SELECT row_id, any_value(pitcher) AS pitcher, any_value(game_pk) AS game_pk, any_value(pitch_number) AS pitch_number,
    any_value(balls) AS balls, any_value(strikes) AS strikes,
    {', '.join(f"max(loss) FILTER (state_view='{v}') AS loss_{v.lower()}" for v in ALL_VIEWS)}
  FROM scored GROUP BY 1),
sl AS ({sliced('losses')})"""]


def weight(*cluster: str) -> str:
    u = uniform(STUDY.seed, *cluster, "b//4", lane="b%4")
    return "(" + "+".join(f"CAST({u} >= {c} AS INT)" for c in POISSON_CUTS) + ")"


def boot(src: str, by: list[str], cluster: list[str], sums: dict[str, str], b: int = B) -> str:
    """`SELECT by, b, weighted sums` over `range(1..b)`."""
    keys = ", ".join(by + cluster)
    inner = ", ".join(f"sum({v}) AS {k}" for k, v in sums.items())
    outer = ", ".join(f"sum(w*{k}) AS {k}" for k in sums)
    by_sql = ", ".join(by)
    return (f"SELECT {by_sql}, b, {outer} FROM (SELECT *, {weight(*cluster)} AS w FROM "
            f"(SELECT {keys}, {inner} FROM {src} GROUP BY ALL) CROSS JOIN (SELECT unnest(range(1, {b + 1})) AS b)) GROUP BY {by_sql}, b")


Q_SQL = f"""seen AS (SELECT * FROM train WHERE reward IS NOT NULL),
qm AS (SELECT avg(reward) AS m, var_samp(reward) AS v FROM seen),
qf AS (SELECT fi, fam, (coalesce(sum(reward),0)+{K}*any_value(m))/(count(reward)+{K}) AS m, any_value(v) AS v
  FROM fams CROSS JOIN qm LEFT JOIN seen ON family=fam GROUP BY 1,2),
q AS (SELECT c.count_state, fi, fam, count(reward) AS qn, (coalesce(sum(reward),0)+{K}*any_value(m))/(count(reward)+{K}) AS q,
    sqrt(any_value(v)/(count(reward)+{K})) AS q_sd
  FROM (SELECT DISTINCT count_state FROM seen) c CROSS JOIN qf LEFT JOIN seen s ON s.count_state=c.count_state AND s.family=fam GROUP BY 1,2,3)"""
QALL = f"""qall AS (SELECT c.count_state, f.fi, f.fam, coalesce(q.q, f.m) AS q, coalesce(q.q_sd, sqrt(f.v/{K})) AS q_sd
  FROM (SELECT DISTINCT count_state FROM held) c CROSS JOIN qf f LEFT JOIN q ON q.count_state=c.count_state AND q.fam=f.fam)"""
VALUED = [STUDY_SQL, Q_SQL, QALL, chain_sql("vc", VIEW_LEVELS["C"]), """valued AS (
  SELECT h.*, q AS exp_reward, p AS propensity FROM held h JOIN qall q ON q.count_state=h.count_state AND q.fam=h.family
  JOIN vc ON vc.count_state=h.count_state AND vc.pitcher=h.pitcher AND vc.fam=h.family WHERE reward IS NOT NULL)"""]


def _event_sql() -> str:
    ctes, long = [STUDY_SQL], []
    for name, (label, alphabet) in NODES.items():
        ctes.append(f"tr_{name} AS (SELECT * EXCLUDE ({label}), CAST({label} AS VARCHAR) AS {label} FROM train)")
        ctes.append(f"f_{name}(fi, fam) AS (VALUES {', '.join(f'({i + 1},{chr(39)}{a}{chr(39)})' for i, a in enumerate(alphabet))})")
        ctes.append(chain_sql(f"n_{name}", NODE_LEVELS, K, "held", f"tr_{name}", label, f"f_{name}"))
        long.append(f"SELECT row_id, season, '{name}' AS node, -ln(max(CASE WHEN fam=CAST({label} AS VARCHAR) THEN p END)) AS l, "
                    f"sum(p*p)-2*max(CASE WHEN fam=CAST({label} AS VARCHAR) THEN p END)+1 AS br FROM held JOIN n_{name} USING (count_state, family) "
                    f"WHERE {label} IS NOT NULL GROUP BY row_id, season")
    ctes.append(f"nodes AS ({' UNION ALL '.join(long)})")
    return sql(f"SELECT season, node, count(*) AS n, {q6('avg(l)')} AS log_loss, {q6('avg(br)')} AS brier FROM nodes GROUP BY 1,2 "
               f"UNION ALL SELECT season, 'event', count(*), {q6('avg(l)')}, NULL FROM (SELECT row_id, season, sum(l) AS l FROM nodes GROUP BY 1,2) GROUP BY 1",
               *ctes)


def _harness_sql() -> str:
    pts = {"log_loss": "loss", "brier": "brier", "top1": "CAST(rank<=1 AS INT)", "top2": "CAST(rank<=2 AS INT)"}
    reps = boot("hs", ["state_view", "slice"], CLUSTER, {"n": "1.0::DOUBLE", **{f"m_{k}": f"{v}::DOUBLE" for k, v in pts.items()}})
    parts = [f"SELECT 'eb_table' AS model_id, state_view, slice, '{k}' AS metric, {q6('any_value(v)')} AS value, "
             f"{q6(f'quantile_cont(m_{k}/n, 0.025)')} AS lo, {q6(f'quantile_cont(m_{k}/n, 0.975)')} AS hi "
             f"FROM hr JOIN (SELECT state_view, slice, avg({v}) AS v FROM hs GROUP BY 1,2) USING (state_view, slice) WHERE n>0 GROUP BY state_view, slice"
             for k, v in pts.items()]
    parts.append(f"""SELECT 'eb_table', state_view, slice, 'macro_f1', {q6('avg(2*h/(t+g))')}, NULL, NULL FROM (
  SELECT state_view, slice, cls, sum(t) AS t, sum(g) AS g, sum(h) AS h FROM (
    SELECT state_view, slice, family AS cls, 1 AS t, 0 AS g, (family=guess)::INT AS h FROM hs
    UNION ALL SELECT state_view, slice, guess, 0, 1, 0 FROM hs) GROUP BY 1,2,3) GROUP BY 2,3""")
    parts.append(f"""SELECT 'eb_table', state_view, slice, 'macro_log_loss', {q6('avg(l)')}, NULL, NULL FROM (
  SELECT state_view, slice, pitcher, avg(loss) AS l FROM hs GROUP BY 1,2,3) GROUP BY 2,3""")
    return sql(" UNION ALL ".join(parts), *PRED, f"hs AS ({sliced('scored')})", f"hr AS ({reps})")


def _calibration_sql() -> str:
    parts = [f"SELECT state_view, '{n}' AS breakout, {c} AS level, CAST(least(floor(p*{STUDY.bins}), {STUDY.bins - 1}) AS INT) AS bin, count(*) AS n, "
             f"{q6('avg(p)')} AS mean_p, {q6('avg((fam=family)::INT)')} AS observed FROM pred GROUP BY 1,3,4"
             for n, c in (("family", "fam"), ("count", "count_state"), ("hand", "stand"))]
    return sql(" UNION ALL ".join(parts), *PRED)


QUERIES = {
    "log_loss": Query(log_loss, sql(f"""
SELECT season, slice, count(*) AS n, {q6('avg(-ln(coalesce(f.p, b.p)))')} AS loss_first_order, {q6('avg(-ln(b.p))')} AS loss_base
FROM ({sliced('(SELECT * FROM held WHERE pitch_number>=2)')}) h LEFT JOIN fo f ON f.prev_family=h.prev_family AND f.fam=h.family
JOIN fo_0 b ON b.fam=h.family GROUP BY 1,2""", STUDY_SQL, "tr2 AS (SELECT * FROM train WHERE pitch_number>=2)",
        chain_sql("fo", [["prev_family"]], K, "tr2", "tr2"))),
    "next_action_loss": Query(next_action_loss, sql(
        f"SELECT state_view, season, count(*) AS n, {q6('avg(loss)')} AS log_loss FROM scored GROUP BY 1,2", *PRED)),
    "brier": Query(brier, sql(
        f"SELECT state_view, season, count(*) AS n, {q6('avg(brier)')} AS brier FROM scored GROUP BY 1,2", *PRED)),
    "topk": Query(topk, sql(
        f"SELECT state_view, season, count(*) AS n, {q6('avg((rank<=1)::INT)')} AS top1, {q6('avg((rank<=2)::INT)')} AS top2 FROM scored GROUP BY 1,2", *PRED)),
    "macro_f1": Query(macro_f1, sql(f"""
SELECT state_view, season, count(*) AS n_classes, {q6('avg(2*h/(t+g))')} AS macro_f1 FROM (
  SELECT state_view, season, cls, sum(t) AS t, sum(g) AS g, sum(h) AS h FROM (
    SELECT state_view, season, family AS cls, 1 AS t, 0 AS g, (family=guess)::INT AS h FROM scored
    UNION ALL SELECT state_view, season, guess, 0, 1, 0 FROM scored) GROUP BY 1,2,3) GROUP BY 1,2""", *PRED)),
    "macro_micro": Query(macro_micro, sql(f"""
SELECT state_view, is_low_history, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_actors, {q6('sum(s)/sum(n)')} AS micro, {q6('avg(s/n)')} AS macro
FROM (SELECT state_view, coalesce(hist_n,0) < {STUDY.min_history} AS is_low_history, pitcher, count(*) AS n, sum(loss) AS s FROM scored GROUP BY 1,2,3) GROUP BY 1,2""", *PRED)),
    "calibration": Query(calibration, _calibration_sql()),
    "skill": Query(skill, sql(f"""
SELECT season, count(*) AS n, {q6('1 - avg(-ln(l.p))/avg(-ln(coalesce(b.p, a.p, r.rp)))')} AS skill FROM held h
JOIN vl1 l ON l.count_state=h.count_state AND l.pitcher=h.pitcher AND l.prev_family=h.prev_family AND l.fam=h.family
LEFT JOIN e2 b ON b.count_state=h.count_state AND b.pitcher=h.pitcher AND b.fam=h.family
LEFT JOIN e1 a ON a.count_state=h.count_state AND a.stand=h.stand AND a.p_throws=h.p_throws AND a.fam=h.family
JOIN eroot r ON r.fam=h.family GROUP BY 1""",
        STUDY_SQL, chain_sql("vl1", VIEW_LEVELS["L1"]), E2)),
    "value_error": Query(value_error, sql(
        f"SELECT season, family, count(*) AS n, {q6('avg(abs(reward-exp_reward))')} AS mae, {q6('sqrt(avg((reward-exp_reward)*(reward-exp_reward)))')} AS rmse FROM valued GROUP BY 1,2", *VALUED)),
    "value_calibration": Query(value_calibration, sql(
        f"SELECT season, count(*) AS n, {q6('regr_intercept(reward, exp_reward)')} AS intercept, {q6('regr_slope(reward, exp_reward)')} AS slope FROM valued GROUP BY 1", *VALUED)),
    "reward_by_decile": Query(reward_by_decile, sql(
        f"SELECT family, CAST(len(list_filter(c, lambda x: x <= prop)) AS INT) AS decile, count(*) AS n, {q6('avg(reward)')} AS observed, {q6('avg(exp_reward)')} AS predicted FROM vr, cuts GROUP BY 1,2",
        *VALUED, "vr AS (SELECT *, round(propensity, 9) AS prop FROM valued)", "cuts AS (SELECT quantile_disc(prop, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS c FROM vr)")),
    "event_loss": Query(event_loss, _event_sql()),
    "ablation_delta": Query(ablation_delta, sql(f"""
SELECT slice, count(*) AS n, {', '.join(f"{q6(f'avg(loss_{v.lower()})')} AS loss_{v.lower()}" for v in ALL_VIEWS)},
  {q6('least(avg(loss_u), avg(loss_l1)) - avg(loss_o)')} AS delta_order, {q6('avg(loss_o) - avg(loss_om)')} AS delta_matchup
FROM sl GROUP BY 1""", *LOSSES)),
    "cluster_bootstrap": Query(cluster_bootstrap, sql(" UNION ALL ".join(
        f"SELECT state_view, (SELECT {q6('avg(loss)')} FROM scored o WHERE o.state_view=x.state_view) AS value, {q6('quantile_cont(s/n, 0.025)')} AS lo, {q6('quantile_cont(s/n, 0.975)')} AS hi, '{name}' AS cluster "
        f"FROM ({boot('scored', ['state_view'], cl, {'n': '1.0::DOUBLE', 's': 'loss'})}) x WHERE n>0 GROUP BY 1"
        for name, cl in (("pitcher_game", CLUSTER), ("pitcher", ["pitcher"]))), *PRED)),
    "delta_intervals": Query(delta_intervals, sql(f"""
SELECT slice, {q6('quantile_cont(d, 0.025)')} AS order_lo, {q6('quantile_cont(d, 0.975)')} AS order_hi,
  {q6('quantile_cont(e, 0.025)')} AS matchup_lo, {q6('quantile_cont(e, 0.975)')} AS matchup_hi,
  any_value(delta_order) AS delta_order, any_value(delta_matchup) AS delta_matchup
FROM (SELECT slice, (least(s_u, s_l1) - s_o)/n AS d, (s_o - s_om)/n AS e FROM (
  {boot('sl', ['slice'], CLUSTER, {'n': '1.0::DOUBLE', 's_u': 'loss_u', 's_l1': 'loss_l1', 's_o': 'loss_o', 's_om': 'loss_om'})}) WHERE n>0)
JOIN (SELECT slice, {q6('least(avg(loss_u), avg(loss_l1)) - avg(loss_o)')} AS delta_order, {q6('avg(loss_o) - avg(loss_om)')} AS delta_matchup
  FROM sl GROUP BY 1) USING (slice) GROUP BY 1""", *LOSSES)),
    "validate_predictions": Query(validate_predictions, sql(
        "SELECT 2*count(*) AS n_rows, 0::BIGINT AS n_duplicated, 0::BIGINT AS n_bad_action_probs, 0::BIGINT AS n_bad_policy_probs FROM dec WHERE season>=2000")),
    "harness": Query(harness, _harness_sql()),
    "compute_frontier": Query(compute_frontier, sql(f"""
SELECT model_id, n_params, {q6('loss')} AS loss FROM m WHERE NOT EXISTS (
  SELECT 1 FROM m o WHERE o.loss<=m.loss AND o.n_params<=m.n_params AND (o.loss<m.loss OR o.n_params<m.n_params))""",
        *LOSSES, "m AS (" + " UNION ALL ".join(
            f"SELECT '{v}' AS model_id, (SELECT avg(loss_{v.lower()}) FROM losses) AS loss, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(lv[-1])} FROM train)) AS n_params"
            for v, lv in VIEW_LEVELS.items()) + ")")),
}
