"""Count tables and shrunken probabilities: the transparent baselines and the pitch grammar.

A chain of nested grouping levels backs off from fine cells to coarse ones. Counts are taken
once at the finest level, written, and summed up from there: the log is read once however long
the chain. (Left lazy, every level would scan the log again, as the filters each join pushes
down differ and keep Spark from reusing the exchange.) The shrinking itself is a column
expression over the joined counts: a cell nobody has seen has count zero and so takes its
parent's value unchanged, and so does a cell with no fewer rows than its parent, as that
is the same rows once more. The root is shrunk to equal shares by one row, so that an action
nobody has taken yet still has a probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from throughline.config import FAMILIES, PITCH, Cols
from throughline.functions.arrays import shrink
from throughline.session import stage


def action_counts(df: DataFrame, keys: list[str], action: str = "family",
                  alphabet=FAMILIES) -> DataFrame:
    """Per cell: `n` and an array `counts` in alphabet order."""
    sums = [F.sum((F.col(action) == a).cast("long")).alias(f"_c{i}")
            for i, a in enumerate(alphabet)]
    return df.groupBy(*keys).agg(*sums).select(*keys, *_packed(alphabet))


def _packed(alphabet) -> list[Column]:
    cells = [F.coalesce(F.col(f"_c{i}"), F.lit(0)) for i in range(len(alphabet))]
    n = cells[0]
    for x in cells[1:]:
        n = n + x
    return [n.alias("n"), F.array(*cells).alias("counts")]


def roll_up(counts: DataFrame, keys: list[str], alphabet=FAMILIES) -> DataFrame:
    """Coarser cells from finer ones."""
    sums = [F.sum(F.col("counts")[i]).alias(f"_c{i}") for i in range(len(alphabet))]
    return counts.groupBy(*keys).agg(*sums).select(*keys, *_packed(alphabet))


def _global_shares(counts: DataFrame, alphabet) -> Column:
    row = roll_up(counts, [], alphabet)
    return row.select(root_shares(len(alphabet))).scalar()


def root_shares(size: int) -> Column:
    """Shares of a row's `counts`, with one more row spread equally over `size` actions."""
    return F.transform("counts", lambda x: (x + F.lit(1.0 / size)) / (F.col("n") + F.lit(1.0)))


def base_freq(df: DataFrame, c: Cols = PITCH) -> DataFrame:
    """Frequency of each action by count and handedness, shrunk to the overall one by one row."""
    t = stage(action_counts(df, ["count_state", "stand", "p_throws"], c.action), "cells")
    return t.withColumn("_root", _global_shares(t, FAMILIES)).withColumn(
        "probs", shrink(F.col("counts"), F.col("n"), F.col("_root"), 1.0)).drop("_root")


def count_cells(train: DataFrame, keys: list[str], action: str = "family",
                alphabet=FAMILIES) -> DataFrame:
    """Counts at the finest keys any level needs, as a written table."""
    return stage(action_counts(train, keys, action, alphabet), "cells")


def eb_views(cells: DataFrame, contexts: DataFrame, views: dict[str, list[list[str]]], k: float,
             alphabet=FAMILIES) -> DataFrame:
    """Shrunken distributions of several chains for every context row.

    `views` maps an output column to nested key lists, coarse to fine and without the empty one.
    A level that several chains share is summed and joined once. Key columns must not be null
    (the study rows carry markers instead), as null never meets null in a join.
    """
    zero = F.array(*[F.lit(0).cast("long") for _ in alphabet])
    out = contexts.withColumn("_shares", _global_shares(cells, alphabet))
    place: dict[tuple[str, ...], int] = {}
    for levels in views.values():
        for keys in levels:
            if tuple(keys) in place:
                continue
            i = place[tuple(keys)] = len(place)
            level = roll_up(cells, keys, alphabet).withColumnsRenamed({"n": f"_n{i}", "counts": f"_k{i}"})
            out = out.join(level, keys, "left")
    made = {}
    for name, levels in views.items():
        probs, above = F.col("_shares"), F.lit(-1)
        for keys in levels:
            i = place[tuple(keys)]
            n = F.coalesce(F.col(f"_n{i}"), F.lit(0))
            own = F.when(n != above, F.coalesce(F.col(f"_k{i}"), zero)).otherwise(zero)
            probs = shrink(own, F.when(n != above, n).otherwise(0), probs, k)
            above = n
        made[name] = probs
    last = place[tuple(next(reversed(views.values()))[-1])]
    return out.select(*contexts.columns, F.coalesce(F.col(f"_n{last}"), F.lit(0)).alias("n"),
                      F.coalesce(F.col(f"_k{last}"), zero).alias("counts"),
                      *[p.alias(n) for n, p in made.items()])


def eb_lookup(train: DataFrame, contexts: DataFrame, levels: list[list[str]], k: float,
              action: str = "family", alphabet=FAMILIES) -> DataFrame:
    """One chain for every context row: `probs`, and the finest level's `n` and `counts`."""
    cells = count_cells(train, levels[-1], action, alphabet)
    return eb_views(cells, contexts, {"probs": levels}, k, alphabet)


def eb_selection(train: DataFrame, levels: list[list[str]], k: float, action: str = "family",
                 alphabet=FAMILIES) -> DataFrame:
    """Shrunken distribution per finest cell seen in training."""
    cells = count_cells(train, levels[-1], action, alphabet)
    return eb_views(cells, cells.select(*levels[-1]), {"probs": levels}, k, alphabet)


def shrunk_pitcher_count(df: DataFrame, k: float, c: Cols = PITCH) -> DataFrame:
    """Actor-by-count shares, shrunk to the global frequency of the same handedness mix."""
    hands = ["stand", "p_throws"]
    fine = count_cells(df, [c.actor, "count_state", *hands], c.action)
    base = roll_up(fine, ["count_state", *hands]).withColumn("_root", _global_shares(fine, FAMILIES)).select(
        "count_state", *hands, shrink(F.col("counts"), F.col("n"), F.col("_root"), 1.0).alias("_base"))
    joined = fine.join(base, ["count_state", *hands])
    idx = range(len(FAMILIES))
    cells = joined.groupBy(c.actor, "count_state").agg(
        *[F.sum(F.col("counts")[i]).alias(f"_c{i}") for i in idx],
        *[F.sum(F.col("n") * F.col("_base")[i]).alias(f"_b{i}") for i in idx])
    packed = cells.select(c.actor, "count_state", *_packed(FAMILIES),
                          F.array(*[F.col(f"_b{i}") for i in idx]).alias("_parent"))
    parent = F.transform("_parent", lambda x: x / F.col("n"))
    return packed.select(c.actor, "count_state", "n", "counts",
                         shrink(F.col("counts"), F.col("n"), parent, k).alias("probs"))


def first_order(train: DataFrame, k: float, action: str = "family",
                alphabet=FAMILIES) -> DataFrame:
    """P(action given the previous action), shrunk to the overall shares."""
    return eb_selection(train, [["prev_family"]], k, action, alphabet)


def pitcher_count_prev(train: DataFrame, k: float, c: Cols = PITCH) -> DataFrame:
    """Actor x count x previous action, shrunk to actor x count."""
    keys = [c.actor, "count_state", "prev_family"]
    cells = action_counts(train, keys, c.action)
    parent = shrunk_pitcher_count(train, k, c).select(
        c.actor, "count_state", F.col("probs").alias("_parent"))
    return cells.join(parent, [c.actor, "count_state"]).select(
        *keys, "n", "counts",
        shrink(F.col("counts"), F.col("n"), F.col("_parent"), k).alias("probs"))


def eb_run_value(train: DataFrame, levels: list[list[str]], k: float,
                 c: Cols = PITCH) -> DataFrame:
    """Partially pooled mean reward per finest cell, and its standard deviation.

    `k` is the prior's weight in observations; every level shares one within-cell variance,
    so precision weighting reduces to (sum + k * parent) / (n + k).
    """
    seen = train.filter(F.col(c.reward).isNotNull())
    finest = stage(seen.groupBy(*levels[-1]).agg(
        F.count("*").alias("n"), F.sum(c.reward).alias("s"),
        F.sum(F.col(c.reward) * F.col(c.reward)).alias("ss")), "cells")
    whole = finest.agg(F.struct(
        (F.sum("s") / F.sum("n")).alias("mean"),
        ((F.sum("ss") - F.sum("s") * F.sum("s") / F.sum("n")) / (F.sum("n") - 1)).alias("var"),
    ).alias("w")).scalar()
    out = finest.select(*levels[-1], "n", F.col("s").alias("_s"), whole.alias("_w"))
    value = F.col("_w")["mean"]
    for i, keys in enumerate(levels[:-1]):
        up = finest.groupBy(*keys).agg(F.sum("n").alias(f"_n{i}"), F.sum("s").alias(f"_s{i}"))
        out = out.join(up, keys)
        value = (F.col(f"_s{i}") + F.lit(k) * value) / (F.col(f"_n{i}") + F.lit(k))
    return out.select(
        *levels[-1], "n", (F.col("_s") / F.col("n")).alias("raw_mean"),
        ((F.col("_s") + F.lit(k) * value) / (F.col("n") + F.lit(k))).alias("mean"),
        F.sqrt(F.col("_w")["var"] / (F.col("n") + F.lit(k))).alias("sd"))


def value_table(train: DataFrame, state: list[str], k: float, c: Cols = PITCH,
                alphabet=FAMILIES) -> DataFrame:
    """q(state, action) for all actions as arrays: cell mean shrunk to the action's mean,
    that to the overall mean; `q_sd` the uncertainty."""
    return state_values(train, state, k, c, alphabet)[0]


def state_values(train: DataFrame, state: list[str], k: float, c: Cols = PITCH, alphabet=FAMILIES) -> tuple[DataFrame, Column]:
    """The value table, and the actions' own means with the variance as a scalar."""
    seen = train.filter(F.col(c.reward).isNotNull())
    idx = range(len(alphabet))
    here = [F.col(c.action) == a for a in alphabet]
    cells = stage(seen.groupBy(*state).agg(
        *[F.sum(h.cast("long")).alias(f"_n{i}") for i, h in enumerate(here)],
        *[F.sum(F.when(h, F.col(c.reward)).otherwise(0.0)).alias(f"_s{i}")
          for i, h in enumerate(here)],
        F.sum(F.col(c.reward) * F.col(c.reward)).alias("_ss")), "cells")
    n_all = sum((F.sum(f"_n{i}") for i in idx), F.lit(0))
    s_all = sum((F.sum(f"_s{i}") for i in idx), F.lit(0.0))
    whole = cells.agg(F.struct(
        F.array(*[(F.sum(f"_s{i}") + F.lit(k) * (s_all / n_all)) / (F.sum(f"_n{i}") + F.lit(k))
                  for i in idx]).alias("q"),
        ((F.sum("_ss") - s_all * s_all / n_all) / (n_all - 1)).alias("var"),
    ).alias("w")).scalar()
    out = cells.withColumn("_w", whole)
    return out.select(
        *state,
        F.array(*[F.col(f"_n{i}") for i in idx]).alias("q_n"),
        F.array(*[(F.col(f"_s{i}") + F.lit(k) * F.col("_w")["q"][i]) / (F.col(f"_n{i}") + F.lit(k))
                  for i in idx]).alias("q"),
        F.array(*[F.sqrt(F.col("_w")["var"] / (F.col(f"_n{i}") + F.lit(k))) for i in idx]).alias("q_sd")), whole


def with_values(rows: DataFrame, values: tuple[DataFrame, Column], state: list[str], k: float,
                alphabet=FAMILIES) -> DataFrame:
    """`rows` with `q`, `q_sd` and `q_n` of their state, from `state_values`; in a state without training rows the actions' own means."""
    table, whole = values
    out = rows.join(table, state, "left").withColumn("_w", whole)
    none = F.array(*[F.lit(0).cast("long") for _ in alphabet])
    alone = F.transform("_w.q", lambda x: F.sqrt(F.col("_w.var") / F.lit(k)))
    return out.withColumns({"q_n": F.coalesce("q_n", none), "q": F.coalesce("q", "_w.q"), "q_sd": F.coalesce("q_sd", alone)}).drop("_w")


# Lower edges of the support bins.
SUPPORT_EDGES = [1, 2, 5, 10, 20, 50, 100]


def support_table(df: DataFrame, levels: dict[str, list[str]], thin: int = 50) -> DataFrame:
    """How many cells have how much support at each level, and what share of decisions
    sits in cells under `thin` rows. All levels are grouping sets of one scan."""
    keys = list(dict.fromkeys(k for ks in levels.values() for k in ks))
    cells = df.groupingSets([[F.col(k) for k in ks] for ks in levels.values()], *keys).agg(
        F.count("*").alias("_size"), F.grouping_id(*keys).alias("_set"))
    # grouping_id sets a bit for every key left out, the first key's bit highest
    level = F.lit(None).cast("string")
    for name, ks in levels.items():
        mask = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in ks)
        level = F.when(F.col("_set") == mask, F.lit(name)).otherwise(level)
    edge = F.lit(0)
    for e in SUPPORT_EDGES:
        edge = F.when(F.col("_size") >= e, F.lit(e)).otherwise(edge)
    return cells.groupBy(level.alias("level"), edge.alias("size_from")).agg(
        F.count("*").alias("n_cells"), F.sum("_size").alias("n_rows"),
        F.sum(F.when(F.col("_size") < thin, F.col("_size")).otherwise(0)).alias("n_thin"))


def markov_backoff(train: DataFrame, depth: int, k: float, action: str = "family",
                   alphabet=FAMILIES) -> DataFrame:
    """Variable-order Markov tables, every depth from 0 to `depth`.

    The context columns are `prev_family, prev2_family, ...` (the start of the episode is a
    token of its own). Depth d backs off to d-1, which drops the oldest token.
    """
    names = [f"prev{'' if d == 1 else d}_family" for d in range(1, depth + 1)]
    cells = count_cells(train, names, action, alphabet)
    out = None
    for d in range(depth + 1):
        if d == 0:
            t = roll_up(cells, [], alphabet).withColumn(
                "probs", root_shares(len(alphabet)))
            context = F.lit("")
        else:
            levels = [names[:j] for j in range(1, d + 1)]
            t = eb_views(cells, cells.select(*names[:d]).distinct(), {"probs": levels}, k, alphabet)
            context = F.concat_ws(">", *[F.col(x) for x in reversed(names[:d])])
        rows = t.select(
            F.lit(d).alias("depth"), context.alias("context"), F.col("n").alias("n_context"),
            F.explode(F.arrays_zip(F.array(*[F.lit(a) for a in alphabet]).alias("a"),
                                   F.col("counts").alias("c"), F.col("probs").alias("p"))).alias("z"))
        rows = rows.select(
            "depth", "context", "n_context", F.col("z.a").alias("action"), F.col("z.c").alias("n"),
            F.col("z.p").alias("p"),
            F.sqrt(F.col("z.p") * (1 - F.col("z.p")) / (F.col("n_context") + F.lit(k) + 1)).alias("sd"))
        out = rows if out is None else out.unionByName(rows)
    return out


def order_patterns(df: DataFrame, n: int, action: str = "family",
                   order: str = "pitch_number") -> DataFrame:
    """Ordered n-grams against what independent draws from the overall shares would give.

    One written count table serves the n-grams, their total and the overall shares.
    """
    names = [f"prev{'' if d == 1 else d}_family" for d in range(n - 1, 0, -1)] + [action]
    whole = (F.col(order) >= n).alias("_whole")
    cells = stage(df.groupBy(*names, whole).agg(F.count("*").alias("n")), "cells")
    grams = cells.filter("_whole")
    total = grams.agg(F.sum("n")).scalar()
    margin = cells.groupBy(F.col(action).alias("_a")).agg(F.sum("n").alias("_n"))
    # one entry per action of the alphabet
    counts = margin.agg(F.map_from_entries(F.collect_list(F.struct("_a", "_n")))).scalar()
    size = cells.agg(F.sum("n")).scalar()
    expected = total.cast("double")
    for x in names:
        expected = expected * (F.element_at(counts, F.col(x)) / size)
    return grams.select(F.concat_ws(">", *names).alias("pattern"), "n",
                        expected.alias("expected"), (F.col("n") / expected).alias("lift"))
