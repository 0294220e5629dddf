"""Queries over F4 and the estimators that read it: propensity and reward models that never saw the row's cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from throughline.config import FAMILIES
from throughline.operators import crossfit, models, ope, policy
from throughline.plans.common import HELD_OUT, STUDY, Query, rounded, spread
from throughline.plans.metric_queries import CLUSTER
from throughline.plans.model_queries import model_rows
from throughline.plans.oracle import r6 as q6, sql, uniform
from throughline.plans.policy_queries import ALPHA, BASE, EST, K, LOW, _bandit, _mixed, est_sql, logged_sql, mixed_sql
from throughline.plans.study import train_and_held
from throughline.session import stage

FOLDS, SEED = 5, STUDY.seed
CONTEXT = ["count_state"]


def _folded(held: DataFrame) -> DataFrame:
    return crossfit.with_fold(held, FOLDS, SEED, CLUSTER)


def _logged(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Rows with out-of-fold mu and q, under mixtures with the target learnt on the training seasons."""
    none = F.array(*[F.lit(False) for _ in FAMILIES])
    aimed = rows.join(_bandit(train).select("count_state", "target"), "count_state", "left").withColumn(
        "target", F.coalesce(policy.restrict(F.col("target"), F.coalesce("feasible", none), F.col("mu")), F.col("mu")))
    return ope.logged(_mixed(aimed), STUDY.weight_cap)


def fold_audit(spark, path):
    return crossfit.fold_audit(_folded(train_and_held(spark, path)[1]), CLUSTER)


def cross_fit_tables(spark, path):
    rows = crossfit.out_of_fold_tables(_folded(train_and_held(spark, path)[1]), CONTEXT, K)
    return rows.select("row_id", "fold", *spread("mu", "mu"), *spread("q", "q"))


def cross_fit_ope(spark, path):
    train, held = train_and_held(spark, path)
    rows = crossfit.out_of_fold_tables(_folded(held), CONTEXT, K)
    return rounded(ope.estimates(_logged(rows, train), ALPHA), *EST)


def cross_fit_model_ope(spark, path):
    """The same estimates with fitted learners: behaviour given the ordered view, reward given the plain one."""
    train, held = train_and_held(spark, path)
    rows = _folded(model_rows(spark, path).filter(HELD_OUT))
    scored = crossfit.out_of_fold_models(
        rows, lambda t: models.fit_behavior(t, "O", "logistic"), lambda t: models.fit_reward(t, "C", "linear"), FOLDS, ["row_id"])
    both = held.join(stage(scored, "out-of-fold"), "row_id")
    return rounded(ope.estimates(_logged(both, train), ALPHA), *EST)


FOLDED_SQL = f"cf AS (SELECT h.*, CAST(floor({uniform(SEED, *CLUSTER)}*{FOLDS}) AS INT) AS fold FROM held h)"
OUT_SQL = f"""cells AS (SELECT count_state, fold, fi, fam, count(*) FILTER (family=fam) AS n, count(reward) FILTER (family=fam) AS m,
    coalesce(sum(reward) FILTER (family=fam), 0) AS s FROM cf CROSS JOIN fams GROUP BY 1,2,3,4),
ctx AS (SELECT count_state, fam, sum(n) AS n, sum(m) AS m, sum(s) AS s FROM cells GROUP BY 1,2),
fld AS (SELECT fold, fam, sum(n) AS n, sum(m) AS m, sum(s) AS s FROM cells GROUP BY 1,2),
tot AS (SELECT fam, sum(n) AS n, sum(m) AS m, sum(s) AS s FROM cells GROUP BY 1),
root AS (SELECT fold, fam, (n + 1.0::DOUBLE/{len(FAMILIES)})/(sum(n) OVER w + 1) AS p,
    (s + {K}*coalesce(sum(s) OVER w / nullif(sum(m) OVER w, 0), 0))/(m + {K}) AS q
  FROM (SELECT fold, fam, t.n - f.n AS n, t.m - f.m AS m, t.s - f.s AS s FROM fld f JOIN tot t USING (fam)) WINDOW w AS (PARTITION BY fold)),
oof AS (SELECT c.count_state, c.fold, c.fi, c.fam, (x.n - c.n + {K}*r.p)/(sum(x.n - c.n) OVER (PARTITION BY c.count_state, c.fold) + {K}) AS mu,
    (x.s - c.s + {K}*r.q)/(x.m - c.m + {K}) AS q
  FROM cells c JOIN ctx x ON x.count_state=c.count_state AND x.fam=c.fam JOIN root r ON r.fold=c.fold AND r.fam=c.fam)"""
AIMED_SQL = """pc AS (SELECT pt.* EXCLUDE (mu, q, tilde), o.mu, o.q,
    CASE WHEN mass>0 THEN (CASE WHEN ok THEN target ELSE 0 END)/mass ELSE o.mu END AS tilde
  FROM pt JOIN cf ON cf.row_id=pt.row_id JOIN oof o ON o.count_state=pt.count_state AND o.fold=cf.fold AND o.fam=pt.fam)"""


def _wide(column: str) -> str:
    return ", ".join(f"{q6(f'max(CASE WHEN fam={chr(39)}{f}{chr(39)} THEN {column} END)')} AS {column}_{low}" for f, low in zip(FAMILIES, LOW, strict=True))


QUERIES = {
    "fold_audit": Query(fold_audit, sql(
        "SELECT fold, sum(n)::BIGINT AS n_rows, count(*) AS n_clusters, ((SELECT count(*) FROM cf) - sum(n))::BIGINT AS n_train_rows, "
        "sum(CASE WHEN folds>1 THEN 1 ELSE 0 END)::BIGINT AS n_shared FROM (SELECT fold, pitcher, game_pk, count(*) AS n, "
        "count(*) OVER (PARTITION BY pitcher, game_pk) AS folds FROM cf GROUP BY 1,2,3) GROUP BY 1", *BASE[:1], FOLDED_SQL)),
    "cross_fit_tables": Query(cross_fit_tables, sql(
        f"SELECT row_id, any_value(cf.fold) AS fold, {_wide('mu')}, {_wide('q')} FROM cf JOIN oof o ON o.count_state=cf.count_state AND o.fold=cf.fold GROUP BY row_id",
        *BASE[:1], FOLDED_SQL, OUT_SQL)),
    "cross_fit_ope": Query(cross_fit_ope, sql(est_sql("alpha"), *BASE, FOLDED_SQL, OUT_SQL, AIMED_SQL, mixed_sql(src="pc", out="pm"), logged_sql(ALPHA))),
    "cross_fit_model_ope": Query(cross_fit_model_ope),
}
