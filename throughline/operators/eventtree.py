"""The whole event tree: swing or take, then ball or called strike, or whiff, foul or in play, then what came of it.

A row ends in one leaf, and a leaf fixes its path. So the log is counted once, by context and leaf; the branches of every
node at every level are sums of that table. The events after contact are read off the training rows, with one more
leaf for those that training never saw. A branch's share is shrunk from level to level; a leaf's probability is the product
along its path, so a context's leaves sum to one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from throughline.session import stage

UNSEEN = "in_play:(unseen)"
#: Leaves without an event after them, and their paths.
PATHS = {"ball": [("swing", "take"), ("take", "ball")], "called_strike": [("swing", "take"), ("take", "called_strike")],
         "whiff": [("swing", "swing"), ("contact", "whiff")], "foul": [("swing", "swing"), ("contact", "foul")]}
_INTO_PLAY = [("swing", "swing"), ("contact", "in_play")]


def leaf() -> Column:
    """A row's leaf, from the labels of `decision.event_tree_labels` and `events`; null for rows outside the tree."""
    return (F.when(F.col("node_contact") == "in_play", F.concat(F.lit("in_play:"), F.coalesce("events", F.lit("(none)"))))
            .when(F.col("node_swing"), F.col("node_contact"))
            .when(F.col("node_called_strike"), F.lit("called_strike")).when(~F.col("node_called_strike"), F.lit("ball")))


def _path(name: Column) -> Column:
    """The (node, branch) pairs on the way to a leaf."""
    def steps(pairs, *more):
        return F.array(*[F.struct(F.lit(n).alias("node"), F.lit(b).alias("branch")) for n, b in pairs], *more)

    out = steps(_INTO_PLAY, F.struct(F.lit("in_play").alias("node"), name.alias("branch")))
    for known, pairs in PATHS.items():
        out = F.when(name == known, steps(pairs)).otherwise(out)
    return out


def leaf_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn("leaf", leaf()).filter(F.col("leaf").isNotNull()).groupBy(*keys, "leaf").agg(F.count(F.lit(1)).alias("n"))


def leaf_probabilities(train: DataFrame, contexts: DataFrame, levels: list[list[str]], k: float) -> DataFrame:
    """(context, leaf, p) for every context row and every leaf. `levels` are nested key lists, coarse to fine, without the empty one.

    A node's shares over all rows are shrunk to equal ones by one row, those of each level to the level above by `k`. Key
    columns must not be null. A context that training lacks takes the finest level it has.
    """
    keys = levels[-1]
    counts = stage(leaf_counts(train, keys), "leaf-counts")
    branches = counts.select(*keys, "n", F.inline(_path(F.col("leaf")))).groupBy(*keys, "node", "branch").agg(F.sum("n").alias("n"))
    # the alphabet of events is a property of the sport, not of the number of rows
    fixed = F.array(*[F.lit(x) for x in [*PATHS, UNSEEN]])
    leaves = counts.agg(F.array_union(fixed, F.collect_set("leaf"))).scalar()
    grid = (contexts.select(*keys).distinct().withColumn("_leaves", leaves)
            .select(*keys, F.size("_leaves").alias("_size"), F.explode("_leaves").alias("leaf"))
            .select(*keys, "_size", "leaf", F.inline(_path(F.col("leaf")))))
    edges = grid.select(*keys, "_size", "node", "branch").distinct()
    width = F.when(F.col("node") == "contact", 3).when(F.col("node") != "in_play", 2).otherwise(F.col("_size") - len(PATHS))
    p = None
    for i, level in enumerate([[], *levels]):
        own = branches.groupBy(*level, "node", "branch").agg(F.sum("n").alias(f"_n{i}"))
        whole = branches.groupBy(*level, "node").agg(F.sum("n").alias(f"_t{i}"))
        edges = edges.join(own, [*level, "node", "branch"], "left").join(whole, [*level, "node"], "left")
        n, t = (F.coalesce(F.col(f"_{x}{i}"), F.lit(0)) for x in "nt")
        p = (n + 1.0 / width) / (t + 1.0) if p is None else (n + k * p) / (t + k)
    shares = edges.select(*keys, "node", "branch", p.alias("_p"))
    return grid.join(shares, [*keys, "node", "branch"]).groupBy(*keys, "leaf").agg(F.product("_p").alias("p"))


def final_event_scores(held: DataFrame, probabilities: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Log loss and Brier score of the final event; an event that training never saw counts as the unseen leaf.

    Works on counts of (by, context, leaf), however many rows there are.
    """
    known = probabilities.groupBy(*keys).agg(F.collect_set("leaf").alias("_leaves"), F.sum(F.col("p") * F.col("p")).alias("_squares"))
    met = (leaf_counts(held, [*by, *keys]).join(known, keys)
           .withColumn("leaf", F.when(F.array_contains("_leaves", F.col("leaf")), F.col("leaf")).otherwise(UNSEEN)))
    scored = met.join(probabilities, [*keys, "leaf"])
    n = F.sum("n")
    return scored.groupBy(*by).agg(n.alias("n"), (F.sum(-F.log("p") * F.col("n")) / n).alias("log_loss"),
                                   (F.sum((F.col("_squares") - 2 * F.col("p") + 1) * F.col("n")) / n).alias("brier"))
