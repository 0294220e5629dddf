"""Queries over section H: does an order finding survive?"""

from __future__ import annotations

from pyspark.sql import functions as F

from throughline.config import FAMILIES
from throughline.functions.arrays import index_of
from throughline.operators import decision, falsify, metrics, tables
from throughline.plans.common import STUDY, TRAIN, Query, r6, rounded
from throughline.plans.metric_queries import B, CLUSTER, LOSSES, boot
from throughline.plans.oracle import digest, r6 as q6, sql, uniform
from throughline.plans.study import (
    STUDY_SQL, VIEW_LEVELS, chain_sql, pair_losses, sliced, study_rows, train_and_held, view_losses, with_views,
)
from throughline.session import stage

SEED = STUDY.seed
K = STUDY.shrink
BETA = 0.004
ROUNDS = 199  # the least p-value is 1/200
#: What a decision knows of the order before it, and so what is exchanged.
HISTORY = ["prev_family", "multiset", "recent", "history_text"]


def order_ablation(spark, path):
    rows = decision.with_slices(view_losses(spark, path))
    t = metrics.delta_intervals(rows, CLUSTER, ["slice"], B, SEED)
    return rounded(falsify.order_ablation(t).select("slice", "order_lo", "order_hi", "order_matters"),
                   "order_lo", "order_hi")


def permute_history(spark, path):
    t = falsify.permute_history(study_rows(spark, path), ["history_text"], SEED)
    return t.select("row_id", "donor_id", "history_text", "donor_history_text")


def pseudo_history(spark, path):
    t = falsify.pseudo_history(study_rows(spark, path), ["history_text"], SEED)
    return t.select("row_id", "donor_id", "donor_history_text")


def moved_share(spark, path):
    t = falsify.permute_history(study_rows(spark, path), [], SEED)
    return rounded(falsify.moved_share(t, ["pitch_number"]), "moved")


# One text per mechanism, from the previous decision.
MECHANISM = {
    "type": "prev_family",
    "location": "concat(cast(prev_plate_x_br > 0 as string), cast(prev_plate_z_norm > 0.5 as string))",
    "velocity": "cast(prev_release_speed >= 83 as string)",
    "release": "cast(prev_release_pos_x >= 0 as string)",
    "outcome": "prev_outcome",
}


def mechanism_ablation(spark, path):
    """Loss of the previous-decision table with all mechanisms, and without each in turn."""
    train, held = train_and_held(spark, path)
    keys = {f"key_{drop}": F.concat_ws("|", *[
        F.coalesce(F.expr(text), F.lit("^")) for m, text in MECHANISM.items() if m != drop])
        for drop in ["none", *MECHANISM]}
    train, held = train.withColumns(keys), held.withColumns(keys)
    held = with_views(held, train, {f"_p_{k}": [["count_state"], ["count_state", k]] for k in keys})
    losses = {k: metrics.log_loss_of(F.col(f"_p_{k}"), F.col("family")) for k in keys}
    wide = held.filter("pitch_number >= 2").agg(*[F.avg(v).alias(k[4:]) for k, v in losses.items()])
    return wide.unpivot([], list(wide.columns), "dropped", "log_loss").select(
        "dropped", r6("log_loss").alias("log_loss"))


def _worlds(spark, path):
    rows = study_rows(spark, path)
    null = falsify.plant_null(rows, SEED).withColumn("world", F.lit("null"))
    return null.unionByName(falsify.plant_effect(rows, BETA, SEED).withColumn("world", F.lit("effect")))


def plant_effect(spark, path):
    return rounded(falsify.speed_gap_slope(_worlds(spark, path), ["world"]), "slope", "gain")


def planted_reward(spark, path):
    return rounded(_worlds(spark, path).select("row_id", "world", "reward"), "reward")


def _history_losses(spark, path, strata):
    """Losses of all views on held-out rows under their own history and under a donor's, by slice."""
    train, held = train_and_held(spark, path)
    keys = VIEW_LEVELS["OM"][-1]
    swapped = falsify.counterfactual(held, HISTORY, SEED, strata)
    cells = stage(falsify.own_and_donor(swapped, keys, HISTORY, [*CLUSTER, "pitch_number", "balls", "strikes", "family"]), "contexts")
    losses = pair_losses(train, cells.select(*keys, "family").distinct())
    rows = decision.with_slices(cells.join(losses, [*keys, "family"]))
    t = falsify.gap_intervals(rows, CLUSTER, ["slice"], list(VIEW_LEVELS), B, SEED)
    return rounded(t, "loss_own", "loss_donor", "gap", "gap_lo", "gap_hi")


def permuted_losses(spark, path):
    """Forecasts under the history of a row alike in all but the order: an edge of the order should be gone."""
    return _history_losses(spark, path, falsify.STRATUM)


def pseudo_losses(spark, path):
    """Forecasts under a history of the same pitcher in a like place: is it the pitcher that is known?"""
    return _history_losses(spark, path, falsify.SIMILAR)


def _reward_gain(rows, train, name, plant):
    """`rows` with the squared-error gain of a line in the speed difference, as a polynomial g0 + g1 x + g2 x^2 of the difference.

    The base is the reward table by count and action; the line is fitted to what it leaves of the training rows.
    """
    left = F.col("reward") - F.element_at("q", index_of(F.col("family"), FAMILIES))
    gap = F.abs(F.col("release_speed") - F.col("prev_release_speed"))
    planted = plant(train)
    values = tables.state_values(planted, ["count_state"], K)
    line = tables.with_values(planted, values, ["count_state"], K).filter("pitch_number >= 2").agg(
        F.struct(F.regr_intercept(left, gap).alias("a"), F.regr_slope(left, gap).alias("b")).alias("l")).scalar()
    valued = tables.with_values(plant(rows), values, ["count_state"], K).withColumns({"_l": line, "_e": left})
    e, a, b = F.col("_e"), F.col("_l.a"), F.col("_l.b")
    return valued.withColumns({f"{name}0": 2 * e * a - a * a, f"{name}1": 2 * e * b - 2 * a * b, f"{name}2": -b * b}).drop(
        "_l", "_e", "q", "q_sd", "q_n")


def permutation_pvalue(spark, path):
    """Gains of fitted models under `ROUNDS` exchanges of the held-out histories within the strata of H2.

    `order`: log loss of O against the better of U and L1. `null`, `effect`: squared error of the reward model with
    the speed difference against the one without it, in the planted worlds.
    """
    train, held = train_and_held(spark, path)
    rows = with_views(held.filter("pitch_number >= 2"), train, {v: VIEW_LEVELS[v] for v in ("U", "L1", "O")})
    rows = rows.withColumns({v: F.transform(v, lambda p: -F.log(F.greatest(p, F.lit(metrics.EPS)))) for v in ("U", "L1", "O")})
    rows = rows.withColumn("place", index_of(F.col("family"), FAMILIES) - 1)
    for name, plant in {"null": lambda df: falsify.plant_null(df, SEED), "effect": lambda df: falsify.plant_effect(df, BETA, SEED)}.items():
        rows = _reward_gain(rows, train, name, plant)

    def line(name):
        def gain(own, donor):
            x = F.abs(own["release_speed"] - donor["prev_release_speed"])
            return own[f"{name}0"] + x * (own[f"{name}1"] + x * own[f"{name}2"])
        return gain

    sums = falsify.shifted_sums(
        rows, ["place", "release_speed", "U", *[f"{w}{i}" for w in ("null", "effect") for i in range(3)]],
        ["prev_release_speed", "L1", "O"],
        {"u": lambda own, donor: own["U"][own["place"]], "l1": lambda own, donor: donor["L1"][own["place"]],
         "o": lambda own, donor: donor["O"][own["place"]], "null": line("null"), "effect": line("effect")}, ROUNDS, SEED)
    gains = sums.select("round", ((F.least("u", "l1") - F.col("o")) / F.col("n")).alias("order"),
                        *[(F.col(w) / F.col("n")).alias(w) for w in ("null", "effect")])
    return rounded(falsify.permutation_pvalue(gains, ["order", "null", "effect"]), "observed_gain", "mean_permuted_gain", "p_value")


# ---------------------------------------------------------------- SQL side

def swap_sql(name: str, strata: list[str], fields: list[str], src: str = "study") -> str:
    w = f"(PARTITION BY {', '.join(strata)} ORDER BY {digest(SEED, 'row_id')}, row_id"
    cols = ", ".join(f"coalesce(lead({f}) OVER {w}), first({f}) OVER {w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS donor_{f}" for f in fields)
    return (f"{name} AS (SELECT *, nullif(coalesce(lead(row_id) OVER {w}), first(row_id) OVER {w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), row_id) AS donor_id"
            f"{', ' + cols if cols else ''} FROM {src} WHERE pitch_number >= 2)")


FI = "list_position(['FF','SI','FC','SL','CU','CH','FS','XX'], family)"
WORLDS = f"""nullw AS (SELECT * EXCLUDE (reward), 0.01::DOUBLE*(strikes-balls) + 0.002::DOUBLE*{FI} + 0.1::DOUBLE*({uniform(SEED, 'row_id')} - 0.5) AS reward FROM study),
worlds AS (SELECT *, 'null' AS world FROM nullw UNION ALL
  SELECT * REPLACE (reward + {BETA}*coalesce(abs(release_speed - prev_release_speed), 0) AS reward), 'effect' FROM nullw)"""
R2 = "power(corr(reward, abs(release_speed - {}prev_release_speed)), 2)"


def _pvalue_sql() -> str:
    strata = ", ".join(falsify.STRATUM)
    vectors = [f"{v}v AS (SELECT {', '.join(VIEW_LEVELS[v][-1])}, list(-ln(greatest(p, 1e-12)) ORDER BY fi) AS {v}w FROM view{v} GROUP BY ALL)"
               for v in ("U", "L1", "O")]
    joins = " ".join(f"JOIN {v}v USING ({', '.join(VIEW_LEVELS[v][-1])})" for v in ("U", "L1", "O"))
    poly = lambda w: f"sum(2*i.e_{w}*l_{w}.a - l_{w}.a*l_{w}.a + x*(2*i.e_{w}*l_{w}.b - 2*l_{w}.a*l_{w}.b - x*l_{w}.b*l_{w}.b))"
    return sql(f"""
SELECT statistic, {q6('max(g) FILTER (r=0)')} AS observed_gain, count(*) FILTER (r>0) AS rounds, {q6('avg(g) FILTER (r>0)')} AS mean_permuted_gain,
  {q6(f'(1 + count(*) FILTER (r>0 AND g >= obs - 1e-12))/(1+{ROUNDS})')} AS p_value
FROM (SELECT *, max(g) FILTER (r=0) OVER (PARTITION BY statistic) AS obs FROM (UNPIVOT gains ON "order", "null", effect INTO NAME statistic VALUE g)) GROUP BY 1""",
               STUDY_SQL, WORLDS, "h2 AS (SELECT * FROM held WHERE pitch_number >= 2)",
               *[chain_sql(f"view{v}", VIEW_LEVELS[v], K, "h2") for v in ("U", "L1", "O")], *vectors,
               f"""wm AS (SELECT world, avg(reward) AS m FROM worlds WHERE {TRAIN} GROUP BY 1),
wf AS (SELECT world, family AS fam, count(*) AS n, sum(reward) AS s FROM worlds WHERE {TRAIN} GROUP BY ALL),
wa AS (SELECT world, fam, (coalesce(s,0)+{K}*m)/(coalesce(n,0)+{K}) AS q FROM wm CROSS JOIN fams LEFT JOIN wf USING (world, fam)),
wn AS (SELECT world, count_state, family AS fam, count(*) AS n, sum(reward) AS s FROM worlds WHERE {TRAIN} GROUP BY ALL),
we AS (SELECT w.*, reward - (coalesce(s,0)+{K}*wa.q)/(coalesce(n,0)+{K}) AS e, abs(release_speed - prev_release_speed) AS x
  FROM worlds w JOIN wa ON wa.world=w.world AND wa.fam=w.family LEFT JOIN wn ON wn.world=w.world AND wn.count_state=w.count_state AND wn.fam=w.family),
wl AS (SELECT world, regr_intercept(e, x) AS a, regr_slope(e, x) AS b FROM we WHERE pitch_number >= 2 AND {TRAIN} GROUP BY 1),
l_null AS (SELECT * FROM wl WHERE world='null'), l_effect AS (SELECT * FROM wl WHERE world='effect'),
ord AS (SELECT h2.row_id, {FI} AS a, Uw, L1w, Ow, release_speed, prev_release_speed, en.e AS e_null, ee.e AS e_effect,
    row_number() OVER (PARTITION BY {strata} ORDER BY {digest(SEED, 'h2.row_id')}, h2.row_id) - 1 AS pos, count(*) OVER (PARTITION BY {strata}) AS m, {uniform(SEED, *falsify.STRATUM)} AS u, dense_rank() OVER (ORDER BY {strata}) AS sid
  FROM h2 {joins} JOIN (SELECT row_id, e FROM we WHERE world='null') en USING (row_id) JOIN (SELECT row_id, e FROM we WHERE world='effect') ee USING (row_id)),
pairs AS (SELECT i.*, r, d.L1w AS dl1, d.Ow AS d_o, abs(i.release_speed - d.prev_release_speed) AS x FROM ord i CROSS JOIN (SELECT unnest(range(0, {ROUNDS + 1})) AS r)
  JOIN ord d ON d.sid=i.sid AND d.pos=(i.pos + CAST(floor((r*i.u - floor(r*i.u))*least(i.m, {ROUNDS + 1})) AS BIGINT))%i.m),
gains AS (SELECT r, (least(sum(Uw[i.a]), sum(dl1[i.a])) - sum(d_o[i.a]))/count(*) AS "order", {poly('null')}/count(*) AS "null", {poly('effect')}/count(*) AS effect
  FROM pairs i, l_null, l_effect GROUP BY 1)""")


def _history_sql(strata: list[str]) -> str:
    keys = VIEW_LEVELS["OM"][-1]
    meta = "row_id, pitcher, game_pk, pitch_number, balls, strikes, family, moved"
    side = lambda d: ", ".join(("donor_" + k + " AS " + k) if d and k in HISTORY else k for k in keys if k != "pitcher")
    first = ", ".join(f"{f} AS donor_{f}" for f in HISTORY)
    losses = " UNION ALL ".join(
        f"SELECT c.row_id, c.donor, '{v}' AS state_view, -ln(greatest(x.p, 1e-12)) AS l FROM ctx c JOIN h{v} x ON x.fam=c.family AND "
        + " AND ".join(f"x.{k}=c.{k}" for k in VIEW_LEVELS[v][-1]) for v in VIEW_LEVELS)
    sums = {"n": "1.0::DOUBLE", **{f"{s}_{v}": f"{s}_{v}" for v in VIEW_LEVELS for s in ("own", "donor")}}
    parts = " UNION ALL ".join(f"""
SELECT p.slice, '{v}' AS state_view, p.n, p.moved, {q6(f'p.own_{v}')} AS loss_own, {q6(f'p.donor_{v}')} AS loss_donor, {q6(f'p.donor_{v} - p.own_{v}')} AS gap,
  {q6(f'quantile_cont((b.donor_{v} - b.own_{v})/b.n, 0.025)')} AS gap_lo, {q6(f'quantile_cont((b.donor_{v} - b.own_{v})/b.n, 0.975)')} AS gap_hi
FROM reps b JOIN points p USING (slice) WHERE b.n > 0 GROUP BY ALL""" for v in VIEW_LEVELS)
    wide = ", ".join(f"max(l) FILTER (donor={d} AND state_view='{v}') AS {s}_{v}" for v in VIEW_LEVELS for d, s in enumerate(("own", "donor")))
    means = ", ".join(f"avg({s}_{v}) AS {s}_{v}" for v in VIEW_LEVELS for s in ("own", "donor"))
    return sql(parts, STUDY_SQL, swap_sql("swapped", strata, HISTORY, "held"),
               f"sides AS (SELECT *, (donor_id IS NOT NULL)::INT AS moved FROM swapped UNION ALL BY NAME SELECT *, {first}, NULL AS donor_id, 0 AS moved FROM held WHERE pitch_number < 2)",
               f"ctx AS (SELECT {meta}, 0 AS donor, {side(0)} FROM sides UNION ALL SELECT {meta}, 1, {side(1)} FROM sides)",
               *[chain_sql(f"h{v}", levels, K, "ctx") for v, levels in VIEW_LEVELS.items()],
               f"cf AS (SELECT row_id, any_value(pitcher) AS pitcher, any_value(game_pk) AS game_pk, any_value(pitch_number) AS pitch_number, any_value(balls) AS balls, "
               f"any_value(strikes) AS strikes, any_value(moved) AS moved, {wide} FROM ({losses}) JOIN (SELECT row_id, pitcher, game_pk, pitch_number, balls, strikes, moved FROM sides) USING (row_id) GROUP BY 1)",
               f"cs AS ({sliced('cf')})", f"reps AS ({boot('cs', ['slice'], CLUSTER, sums)})",
               f"points AS (SELECT slice, count(*) AS n, CAST(sum(moved) AS BIGINT) AS moved, {means} FROM cs GROUP BY 1)")


_MECH_SQL = {
    "type": "prev_family",
    "location": "CAST(prev_plate_x_br > 0 AS VARCHAR)||CAST(prev_plate_z_norm > 0.5 AS VARCHAR)",
    "velocity": "CAST(prev_release_speed >= 83 AS VARCHAR)",
    "release": "CAST(prev_release_pos_x >= 0 AS VARCHAR)",
    "outcome": "prev_outcome",
}


def _mechanism_sql() -> str:
    drops = ["none", *_MECH_SQL]
    keys = ", ".join("concat_ws('|', " + ", ".join(f"coalesce({t}, '^')" for m, t in _MECH_SQL.items() if m != d) + f") AS key_{d}" for d in drops)
    parts = [f"SELECT '{d}' AS dropped, {q6('avg(-ln(p))')} AS log_loss FROM heldk h JOIN x{d} x ON x.count_state=h.count_state AND x.key_{d}=h.key_{d} AND x.fam=h.family WHERE pitch_number>=2"
             for d in drops]
    return sql(" UNION ALL ".join(parts), STUDY_SQL, f"traink AS (SELECT *, {keys} FROM train)", f"heldk AS (SELECT *, {keys} FROM held)",
               *[chain_sql(f"x{d}", [["count_state"], ["count_state", f"key_{d}"]], K, "heldk", "traink") for d in drops])


QUERIES = {
    "order_ablation": Query(order_ablation, sql(f"""
SELECT slice, {q6('quantile_cont(d, 0.025)')} AS order_lo, {q6('quantile_cont(d, 0.975)')} AS order_hi, quantile_cont(d, 0.025) > 0 AS order_matters
FROM (SELECT slice, (least(s_u, s_l1) - s_o)/n AS d FROM (
  {boot('sl', ['slice'], CLUSTER, {'n': '1.0::DOUBLE', 's_u': 'loss_u', 's_l1': 'loss_l1', 's_o': 'loss_o'})}) WHERE n>0) GROUP BY 1""", *LOSSES)),
    "permute_history": Query(permute_history, sql(
        "SELECT row_id, donor_id, history_text, donor_history_text FROM swapped", STUDY_SQL,
        swap_sql("swapped", falsify.STRATUM, ["history_text"]))),
    "pseudo_history": Query(pseudo_history, sql(
        "SELECT row_id, donor_id, donor_history_text FROM swapped", STUDY_SQL,
        swap_sql("swapped", falsify.SIMILAR, ["history_text"]))),
    "moved_share": Query(moved_share, sql(
        f"SELECT pitch_number, count(*) AS n, {q6('avg((donor_id IS NOT NULL)::INT)')} AS moved FROM swapped GROUP BY 1", STUDY_SQL,
        swap_sql("swapped", falsify.STRATUM, []))),
    "mechanism_ablation": Query(mechanism_ablation, _mechanism_sql()),
    "planted_reward": Query(planted_reward, sql(
        f"SELECT row_id, world, {q6('reward')} AS reward FROM worlds", STUDY_SQL, WORLDS)),
    "plant_effect": Query(plant_effect, sql(
        f"SELECT world, count(*) AS n, {q6('regr_slope(reward, abs(release_speed - prev_release_speed))')} AS slope, {q6(R2.format(''))} AS gain FROM worlds WHERE pitch_number >= 2 GROUP BY 1", STUDY_SQL, WORLDS)),
    "permutation_pvalue": Query(permutation_pvalue, _pvalue_sql()),
    "permuted_losses": Query(permuted_losses, _history_sql(falsify.STRATUM)),
    "pseudo_losses": Query(pseudo_losses, _history_sql(falsify.SIMILAR)),
}
