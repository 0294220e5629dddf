"""Out-of-fold behaviour and reward models: no row is scored by a model that saw its cluster.

Each row gets `fold`, `mu` (behaviour) and `q` (reward of every action). For count models, leaving a fold out is a
subtraction: cells are counted once by context and fold, and a fold's own counts are taken from the totals. So any
number of folds costs one pass over the log. MLlib learners are fitted once for each fold.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from throughline.config import FAMILIES, PITCH, Cols
from throughline.functions import hashing
from throughline.functions.arrays import total
from throughline.operators.models import Fitted
from throughline.session import stage

#: What a cell holds: arrays in family order of decisions, of those with a reward, and of reward sums.
PARTS = ("n", "m", "s")


def with_fold(df: DataFrame, folds: int, seed: int, cluster: list[str]) -> DataFrame:
    return df.withColumn("fold", hashing.fold(seed, folds, *cluster))


def fold_audit(rows: DataFrame, cluster: list[str]) -> DataFrame:
    """Per fold: its rows and clusters, the rows that train its models, and clusters that lie in other folds as well (none may)."""
    per = rows.groupBy("fold", *cluster).agg(F.count(F.lit(1)).alias("_n"))
    # null-safe, as a cluster without a key is one as well
    spread = per.groupBy(*cluster).agg(F.count(F.lit(1)).alias("_folds"), F.collect_list(F.struct("fold", "_n")).alias("_in"))
    own = spread.select("_folds", F.inline("_in")).groupBy("fold").agg(
        F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_clusters"),
        F.sum((F.col("_folds") > 1).cast("long")).alias("n_shared"))
    everything = rows.agg(F.count(F.lit(1))).scalar()
    return own.withColumn("n_train_rows", everything - F.col("n_rows"))


def _summed(df: DataFrame, by: list[str], prefix: str) -> DataFrame:
    return df.groupBy(*by).agg(*[F.sum(f"{p}{i}").alias(f"{prefix}{p}{i}") for p in PARTS for i in range(len(FAMILIES))])


def _array(part: str, whole: str, own: str) -> Column:
    return F.array(*[(F.col(f"{whole}{part}{i}") - F.col(f"{own}{part}{i}")).cast("double") for i in range(len(FAMILIES))])


def fold_tables(rows: DataFrame, context: list[str], k: float, c: Cols = PITCH) -> DataFrame:
    """(context, fold, mu, q) from the rows of all other folds.

    Behaviour: shares of the actions, shrunk by `k` decisions to those of all contexts, which one row shrinks to equal
    shares; so every action has a probability. Reward: means, shrunk by `k` to the action's mean over all contexts, and
    that one to the mean of all rewards (0 without any).
    """
    one = {"n": lambda hit: hit.cast("long"), "m": lambda hit: (hit & F.col(c.reward).isNotNull()).cast("long"),
           "s": lambda hit: F.when(hit, F.coalesce(F.col(c.reward).cast("double"), F.lit(0.0))).otherwise(0.0)}
    hits = [F.coalesce(F.col(c.action) == a, F.lit(False)) for a in FAMILIES]
    cells = stage(rows.groupBy(*context, "fold").agg(*[F.sum(one[p](h)).alias(f"{p}{i}") for p in PARTS for i, h in enumerate(hits)]),
                  "fold-cells")
    same = reduce(lambda a, b: a & b, [F.col(f"a.{x}").eqNullSafe(F.col(f"b.{x}")) for x in context])
    whole, by_fold = _summed(cells, context, "w_"), _summed(cells, ["fold"], "f_")
    wide = (cells.alias("a").join(whole.alias("b"), same).drop(*[F.col(f"b.{x}") for x in context])
            .join(by_fold, "fold").withColumn("_t", _summed(cells, [], "t_").select(F.struct("*")).scalar()).select("*", "_t.*"))
    wide = wide.select(*context, "fold", *[_array(p, "w_", "").alias(f"_{p}") for p in PARTS],
                       *[_array(p, "t_", "f_").alias(f"_r{p}") for p in PARTS])
    shares = F.transform("_rn", lambda x: (x + 1.0 / len(FAMILIES)) / (total(F.col("_rn")) + 1.0))
    mean = F.coalesce(F.try_divide(total(F.col("_rs")), total(F.col("_rm"))), F.lit(0.0))
    means = F.zip_with("_rs", "_rm", lambda s, m: (s + k * F.col("_mean")) / (m + k))
    wide = wide.withColumns({"_shares": shares, "_mean": mean}).withColumn("_means", means)
    return wide.select(
        *context, "fold", F.zip_with("_n", "_shares", lambda n, p: (n + k * p) / (total(F.col("_n")) + k)).alias("mu"),
        F.transform(F.arrays_zip("_s", "_m", "_means"), lambda z: (z["_s"] + k * z["_means"]) / (z["_m"] + k)).alias("q"))


def out_of_fold_tables(rows: DataFrame, context: list[str], k: float, c: Cols = PITCH) -> DataFrame:
    """Rows (that have a `fold`) with `mu` and `q` of the count models that left their fold out."""
    cells = fold_tables(rows, context, k, c)
    same = reduce(lambda a, b: a & b, [F.col(f"a.{x}").eqNullSafe(F.col(f"b.{x}")) for x in [*context, "fold"]])
    return rows.alias("a").join(cells.alias("b"), same).select("a.*", "b.mu", "b.q")


def out_of_fold_models(rows: DataFrame, behavior: Callable[[DataFrame], Fitted], reward: Callable[[DataFrame], Fitted],
                       folds: int, keys: list[str], even: float = 0.001) -> DataFrame:
    """(keys, fold, mu, q) by learners fitted on all other folds. Behaviour is mixed with equal shares of weight `even`, so that
    an action that a training part lacks has a probability."""
    parts = []
    for i in range(folds):
        train = rows.filter(F.col("fold") != i)
        scored = reward(train).predict(behavior(train).predict(rows.filter(F.col("fold") == i)))
        mu = F.transform("action_probs", lambda p: (1 - even) * p + even / len(FAMILIES))
        parts.append(scored.select(*keys, "fold", mu.alias("mu"), "q"))
    return reduce(DataFrame.unionByName, parts)
