"""Target policies and the tabular decision process."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from throughline.config import FAMILIES, OTHER_FAMILY, PITCH, Cols
from throughline.functions import hashing
from throughline.functions.arrays import normalise, total
from throughline.session import cut

END = "end"
#: Steps (state, action, next state) of all policies that are taken as rows of lists.
SMALL = 20_000


def bandit_policy(q_table: DataFrame, state: list[str], draws: int, seed: int,
                  alphabet=FAMILIES) -> DataFrame:
    """Per state, the share of posterior draws in which each recommendable action is best.

    Runs on the value table (one row per state), not on the log.
    """
    sampled = F.array(*[
        F.lit(float("-inf")) if a == OTHER_FAMILY
        else F.col("q")[i] + F.col("q_sd")[i] * hashing.normal(
            seed, *state, F.lit(a), F.col("_draw"))
        for i, a in enumerate(alphabet)])
    drawn = q_table.select(*state, "q", "q_sd",
                           F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_draw"))
    best = drawn.select(*state, F.array_position(sampled, F.array_max(sampled)).alias("_best"))
    shares = [F.avg((F.col("_best") == i + 1).cast("double")) for i in range(len(alphabet))]
    return best.groupBy(*state).agg(F.array(*shares).alias("target"))


def restrict(target: Column, feasible: Column, fallback: Column) -> Column:
    """Target kept to feasible actions and rescaled; the fallback where nothing is left."""
    kept = F.zip_with(target, feasible, lambda p, ok: F.when(ok, p).otherwise(F.lit(0.0)))
    mass = total(kept)
    return F.when(mass > 0, F.transform(kept, lambda x: F.try_divide(x, mass))).otherwise(fallback)


def mix_policy(mu: Column, target: Column, alpha: Column | float) -> Column:
    """(1 - alpha) * behaviour + alpha * target."""
    a = F.lit(alpha) if isinstance(alpha, (int, float)) else alpha
    return F.zip_with(mu, target, lambda m, t: (1 - a) * m + a * t)


def transitions(df: DataFrame, state: str = "count_state", c: Cols = PITCH) -> DataFrame:
    """Counts and mean rewards of (state, action) -> next state; the last decision goes to `end`."""
    w = W.partitionBy(c.game, c.at_bat).orderBy(c.order)
    steps = df.select(
        F.col(state).alias("state"), F.col(c.action).alias("action"), c.reward,
        F.coalesce(F.lead(state).over(w), F.lit(END)).alias("next_state"))
    return steps.groupBy("state", "action", "next_state").agg(
        F.count("*").alias("n"), F.count(c.reward).alias("n_reward"),
        F.coalesce(F.sum(c.reward), F.lit(0.0)).alias("sum_reward"))


def _steps(trans: DataFrame, prior: float = 0.0) -> DataFrame:
    """(state, action, next_state) with `prob`, mean reward `r` and behaviour `mu`.

    `prior` decisions of each action go where all decisions of its state went. Without any, an
    action that never ended an episode in a few rows could be worth following for ever.
    """
    per_action = trans.groupBy("state", "action").agg(
        F.sum("n").alias("_na"),
        F.coalesce(F.try_divide(F.sum("sum_reward"), F.sum("n_reward")), F.lit(0.0)).alias("r"))
    ways = trans.groupBy("state", "next_state").agg(F.sum("n").alias("_nw"))
    per_state = trans.groupBy("state").agg(F.sum("n").alias("_ns"))
    cells = per_action.join(per_state, "state")
    if prior:
        cells = cells.join(ways, "state").join(trans.select("state", "action", "next_state", "n"), ["state", "action", "next_state"], "left")
        prob = (F.coalesce("n", F.lit(0)) + F.lit(prior) * F.col("_nw") / F.col("_ns")) / (F.col("_na") + F.lit(prior))
    else:
        cells = cells.join(trans.select("state", "action", "next_state", "n"), ["state", "action"])
        prob = F.col("n") / F.col("_na")
    return cells.select("state", "action", "next_state", prob.alias("prob"), "r", (F.col("_na") / F.col("_ns")).alias("mu"))


class NoFixedPoint(RuntimeError):
    """The values of a policy still move after as many rounds as were allowed."""


class Choice:
    """How the value of a state comes from its actions: weighted by the policy, or the best after a price."""

    def __init__(self, price: Callable[[Callable[[str], Column]], Column] | None = None, best: bool = False):
        self.price, self.best = price or (lambda get: F.lit(0.0)), best

    def of_rows(self) -> Column:
        """Over the rows (action, mu, pi, q) of a state."""
        if self.best:
            return F.max(F.when(F.col("action") != OTHER_FAMILY, F.col("q") - self.price(F.col)))
        return F.coalesce(F.try_divide(F.sum(F.col("pi") * F.col("q")), F.sum("pi")), F.lit(0.0))

    def of_list(self, acts: Column) -> Column:
        """Over the array (action, mu, pi, q) of a state."""
        if self.best:
            open_ = F.filter(acts, lambda a: a["action"] != OTHER_FAMILY)
            return F.array_max(F.transform(open_, lambda a: a["q"] - self.price(lambda name: a[name])))
        mass = F.aggregate(acts, F.lit(0.0), lambda t, a: t + a["pi"])
        return F.coalesce(F.try_divide(F.aggregate(acts, F.lit(0.0), lambda t, a: t + a["pi"] * a["q"]), mass), F.lit(0.0))


FOLLOW, BEST = Choice(), Choice(best=True)


def _fixed_point(steps: DataFrame, choice: Choice, by: list[str], tolerance: float = 1e-9, limit: int = 8192,
                 few: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Q and V at the point where another round of value iteration moves no V by more than `tolerance`.

    Works on distinct (state, action, next state), however long the log is. Up to `few` of them (counted first) are one
    row for each policy, and rounds are expressions of that row; more are joined and summed round by round. The
    largest change is the one number that reaches the driver, after each run of rounds.
    """
    small = steps.count() <= (SMALL if few is None else few)
    return (_rounds_in_rows if small else _rounds_by_joins)(steps, choice, by, tolerance, limit)


def _still(moved: float | None, tolerance: float, rounds: int, limit: int) -> bool:
    if moved is not None and moved > tolerance and rounds >= limit:
        raise NoFixedPoint(f"values still move by {moved} after {rounds} rounds: some states are never left")
    return moved is None or moved <= tolerance


def _rounds_in_rows(steps: DataFrame, choice: Choice, by: list[str], tolerance: float, limit: int, every: int = 256):
    acts = (steps.groupBy(*by, "state", "action", "r", "mu", "pi").agg(F.collect_list(F.struct("next_state", "prob")).alias("nexts"))
            .groupBy(*by, "state").agg(F.array_sort(F.collect_list(F.struct("action", "r", "mu", "pi", "nexts"))).alias("acts"))
            .groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("state", "acts"))).alias("table")))
    # a next state's place among the states; 0 is the end, which is worth nothing
    names = F.col("table")["state"]
    placed = F.transform("table", lambda t: F.struct(t["state"].alias("state"), F.transform(t["acts"], lambda a: F.struct(
        *[a[x].alias(x) for x in ("action", "r", "mu", "pi")],
        F.transform(a["nexts"], lambda n: F.struct(F.array_position(names, n["next_state"]).cast("int").alias("place"), n["prob"].alias("prob"))).alias("nexts"))).alias("acts")))
    rows = acts.select(*by, placed.alias("table"))
    rows = cut(rows.withColumn("v", F.concat(F.array(F.lit(0.0)), F.transform("table", lambda t: F.lit(0.0)))))

    def qualities(acts: Column, v: Column) -> Column:
        return F.transform(acts, lambda a: F.struct(
            *[a[x].alias(x) for x in ("action", "mu", "pi")],
            (a["r"] + F.aggregate(a["nexts"], F.lit(0.0), lambda t, n: t + n["prob"] * v[n["place"]])).alias("q")))

    def step(v: Column) -> Column:
        return F.concat(F.array(F.lit(0.0)), F.transform("table", lambda t: choice.of_list(qualities(t["acts"], v))))

    rounds = 0
    while True:
        rounds += every
        moves = F.array_max(F.zip_with(step(F.col("v")), F.col("v"), lambda a, b: F.abs(a - b)))
        run = F.aggregate(F.sequence(F.lit(1), F.lit(every)), F.col("v"), lambda v, _: step(v))
        rows = cut(rows.withColumn("v", run).withColumn("moved", moves))
        if _still(rows.agg(F.max("moved")).first()[0], tolerance, rounds, limit):
            break
    each = rows.select(*by, "v", F.posexplode("table").alias("_at", "t"))
    q = each.select(*by, "t.state", F.inline(qualities(F.col("t.acts"), F.col("v")))).select(*by, "state", "action", "mu", "pi", "q")
    return q, each.select(*by, "t.state", F.col("v")[F.col("_at") + 1].alias("v"))


def _rounds_by_joins(steps: DataFrame, choice: Choice, by: list[str], tolerance: float, limit: int, every: int = 16):
    cell = [*by, "state", "action", "r", "mu", "pi"]

    def quality(value: DataFrame) -> DataFrame:
        ahead = steps.join(value.withColumnsRenamed({"state": "next_state"}), [*by, "next_state"], "left")
        q = ahead.groupBy(*cell).agg(F.sum(F.col("prob") * F.coalesce(F.col("v"), F.lit(0.0))).alias("_next"))
        return q.select(*by, "state", "action", "mu", "pi", (F.col("r") + F.col("_next")).alias("q"))

    value, rounds = cut(steps.select(*by, "state").distinct().withColumn("v", F.lit(0.0))), 0
    while True:
        new = value
        for _ in range(every):
            new = quality(new).groupBy(*by, "state").agg(choice.of_rows().alias("v"))
        new, rounds = cut(new), rounds + every
        moved = new.join(value.withColumnRenamed("v", "_before"), [*by, "state"]).agg(F.max(F.abs(F.col("v") - F.col("_before")))).first()[0]
        value = new
        if _still(moved, tolerance, rounds, limit):
            return quality(value), value


def _with_policy(steps: DataFrame, policy: DataFrame | None, by: list[str]) -> DataFrame:
    """Join (state, action, pi) rows; behaviour if there are none, and in states that the policy leaves out."""
    if policy is None:
        return steps.withColumn("pi", F.col("mu"))
    if not by:
        known = policy.select("state", "action", "pi")
        states = known.select("state").distinct().withColumn("_known", F.lit(True))
        out = steps.join(known, ["state", "action"], "left").join(states, "state", "left")
    else:
        states = policy.select(*by, "state").distinct().withColumn("_known", F.lit(True))
        names = policy.agg(F.collect_set(F.struct(*by))).scalar()  # one entry for each policy
        each = steps.select("*", F.inline(names))
        out = each.join(policy.select(*by, "state", "action", "pi"), [*by, "state", "action"], "left").join(states, [*by, "state"], "left")
    return out.withColumn("pi", F.when(F.col("_known"), F.coalesce("pi", F.lit(0.0))).otherwise(F.col("mu"))).drop("_known")


def policy_rows(policy: DataFrame, state: str, probs: str, alphabet=FAMILIES) -> DataFrame:
    """A per-state probability vector as (state, action, pi) rows."""
    cells = F.array(*[F.struct(F.lit(a).alias("action"), F.col(probs)[i].alias("pi"))
                      for i, a in enumerate(alphabet)])
    return policy.select(F.col(state).alias("state"), F.inline(cells))


def mdp_value(trans: DataFrame, policy: DataFrame | None = None, by: list[str] | None = None, prior: float = 0.0) -> DataFrame:
    """Value per state of following a policy (behaviour if None) to the end of the episode."""
    steps = cut(_with_policy(_steps(trans, prior), policy, by or []))
    return _fixed_point(steps, FOLLOW, by or [])[1]


def fqe(trans: DataFrame, policy: DataFrame | None = None, by: list[str] | None = None, prior: float = 0.0) -> DataFrame:
    """Fitted-Q evaluation with one cell per (state, action): the least-squares fit is the mean.

    `by` names columns of `policy` that tell several policies apart; all run together.
    """
    steps = cut(_with_policy(_steps(trans, prior), policy, by or []))
    return _fixed_point(steps, FOLLOW, by or [])[0].select(
        *(by or []), "state", "action", "pi", "q")


def greedy_value(trans: DataFrame, prior: float = 1.0) -> DataFrame:
    """Best value per state and the action that attains it."""
    steps = cut(_with_policy(_steps(trans, prior), None, []))
    q, value = _fixed_point(steps, BEST, [])
    choice = q.filter(F.col("action") != OTHER_FAMILY).groupBy("state").agg(
        F.max_by("action", "q").alias("action"))
    return value.join(choice, "state")


def conservative_q(trans: DataFrame, beta: float, prior: float = 1.0) -> DataFrame:
    """Greedy full-episode values with a price on leaving the data: an action of behaviour
    probability mu pays beta * (1 / mu - 1), the penalty for choosing it outright."""
    steps = cut(_with_policy(_steps(trans, prior), None, []))
    choice = Choice(lambda get: F.lit(beta) * (1 / get("mu") - 1), best=True)
    q, _ = _fixed_point(steps, choice, [])
    return q.select("state", "action", "mu", "q", (F.col("q") - choice.price(F.col)).alias("q_conservative"))


def conservative_policy(q: DataFrame, state: str, temperature: float, alphabet=FAMILIES) -> DataFrame:
    """Per state the distribution `target`: behaviour times exp(conservative value / temperature), over the actions that may be recommended.

    It is the best one for value less temperature times the divergence from behaviour, so an action that
    was never taken keeps probability zero. In a state without such an action `target` is null.
    """
    seen = q.filter(F.col("action") != OTHER_FAMILY)
    top = seen.groupBy("state").agg(F.max("q_conservative").alias("_top"))
    weight = F.col("mu") * F.exp((F.col("q_conservative") - F.col("_top")) / F.lit(temperature))
    weights = seen.join(top, "state").withColumn("_w", weight)
    sums = [F.sum(F.when(F.col("action") == a, F.col("_w")).otherwise(0.0)) for a in alphabet]
    packed = weights.groupBy(F.col("state").alias(state)).agg(F.array(*sums).alias("_t"))
    return packed.select(state, normalise(F.col("_t")).alias("target"))
