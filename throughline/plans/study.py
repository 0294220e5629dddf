"""The processed decision rows every model and evaluation reads, built once per input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from throughline.config import FAMILIES, PITCH
from throughline.operators import history
from throughline.operators.metrics import log_loss_of
from throughline.operators.tables import count_cells, eb_views
from throughline.plans.common import HELD_OUT, STUDY, TRAIN, table
from throughline.plans.history_queries import MIX
from throughline.session import small_side, stage

_built: dict[tuple[str, str], DataFrame] = {}

KEEP = ["row_id", "pa_id", "game_pk", "game_date", "at_bat_number", "pitch_number", "pitcher",
        "batter", "stand", "p_throws", "balls", "strikes", "count_state", "outs_when_up",
        "base_state", "family", "outcome", "events", "reward", "release_speed",
        "prev_family", "prev2_family", "prev3_family", "prev_release_speed", "prev_outcome",
        "prev_plate_x_br", "prev_plate_z_norm", "prev_release_pos_x",
        "multiset", "recent", "history_text", "met", "hist_n", "feasible", "node_swing",
        "node_called_strike", "node_contact", "score_diff_pitcher", "season"]
#: Columns that come from other games.
ACROSS = ["hist_n", "feasible"]
START = "^"


def build(decisions: DataFrame) -> DataFrame:
    """Decision rows with the history keys the tabular models group by, but for those across games."""
    w = W.partitionBy(PITCH.game, PITCH.at_bat).orderBy(PITCH.order)
    df = history.pa_history(decisions, ["family"])
    prior = F.transform("history", lambda t: t["family"])
    df = df.withColumns({
        **{f"prev{'' if d == 1 else d}_family": F.coalesce(F.lag("family", d).over(w), F.lit(START))
           for d in (1, 2, 3)},
        **{f"prev_{x}": F.lag(x).over(w) for x in (
            "release_speed", "outcome", "plate_x_br", "plate_z_norm", "release_pos_x")},
        "history_text": F.array_join(prior, ">"),
        "multiset": F.array_join(F.array_sort(prior), "+"),
        "recent": F.array_join(F.slice(prior, F.greatest(F.size("history") - STUDY.markov_depth + 1, F.lit(1)), STUDY.markov_depth), ">"),
        "met": (F.col("times_thru_order") > 1).cast("int"),
    })
    return df.select(*[c for c in KEEP if c not in ACROSS])


def with_repertoire(rows: DataFrame) -> DataFrame:
    """Written `rows` with their actor's mix as of the date, summed up from the rows themselves; there is one row per actor and date."""
    mix = history.feasible_mask(
        history.repertoire_mix(rows, STUDY.window_days), STUDY.min_count, STUDY.min_share)
    return rows.join(small_side(mix.select("pitcher", "game_date", *ACROSS)), ["pitcher", "game_date"], "left").select(*KEEP)


def study_rows(spark: SparkSession, path: str) -> DataFrame:
    """Written once per session and input, partitioned by season; readers prune the rest.

    Tasks write the rows that they hold: moving the finished rows by season would cost more than all that comes before.
    """
    key = (spark.sparkContext.applicationId, path)
    if key not in _built:
        rows = with_repertoire(stage(build(table(spark, path)), "in-game"))
        _built[key] = stage(rows, "decisions", "season", moved=False)
    return _built[key]


# Nested grouping levels of the five tabular state views.
VIEW_LEVELS = {
    "C": [["count_state"], ["count_state", "pitcher"]],
    "U": [["count_state"], ["count_state", "pitcher"], ["count_state", "pitcher", "multiset"]],
    "L1": [["count_state"], ["count_state", "pitcher"], ["count_state", "pitcher", "prev_family"]],
}
# O knows what U and L1 know, and the whole order.
VIEW_LEVELS["O"] = [*VIEW_LEVELS["L1"], *[[*VIEW_LEVELS["L1"][-1], *more] for more in (
    ["multiset"], ["multiset", "recent"], ["multiset", "recent", "history_text"])]]
VIEW_LEVELS["OM"] = [*VIEW_LEVELS["O"], [*VIEW_LEVELS["O"][-1], "met"]]


def with_views(rows: DataFrame, train: DataFrame, views: dict[str, list[list[str]]],
               k: float = STUDY.shrink, action: str = "family", alphabet=FAMILIES) -> DataFrame:
    """Add one table model's distribution per entry of `views`.

    The training rows are counted once for all of them, the chains are resolved on the distinct
    contexts, and the rows join once.
    """
    keys = list(dict.fromkeys(x for levels in views.values() for x in levels[-1]))
    cells = count_cells(train, keys, action, alphabet)
    look = eb_views(cells, rows.select(*keys).distinct(), views, k, alphabet)
    return rows.join(look.select(*keys, *views), keys, "left")


def with_probs(rows: DataFrame, train: DataFrame, levels: list[list[str]], out: str,
               k: float = STUDY.shrink, action: str = "family", alphabet=FAMILIES) -> DataFrame:
    return with_views(rows, train, {out: levels}, k, action, alphabet)


def train_and_held(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = study_rows(spark, path)
    return rows.filter(TRAIN), rows.filter(HELD_OUT)


def predictions(spark: SparkSession, path: str, views=("C", "L1")) -> DataFrame:
    """Held-out rows, one copy per view, with the view's table model as forecast."""
    train, held = train_and_held(spark, path)
    rows = with_views(held, train, {f"_p_{v}": VIEW_LEVELS[v] for v in views})
    cells = F.array(*[F.struct(F.lit(v).alias("state_view"), F.col(f"_p_{v}").alias("action_probs"))
                      for v in views])
    return rows.select(*held.columns, F.lit("eb_table").alias("model_id"), F.inline(cells))


def view_losses(spark: SparkSession, path: str) -> DataFrame:
    """Held-out rows with one log-loss column per view.

    The loss is a function of the context and the action, so it is computed once per distinct
    pair and the rows join five numbers, not five distributions.
    """
    train, held = train_and_held(spark, path)
    keys = VIEW_LEVELS["OM"][-1]
    return held.join(pair_losses(train, held.select(*keys, "family").distinct()), [*keys, "family"])


def pair_losses(train: DataFrame, pairs: DataFrame) -> DataFrame:
    """One log-loss column per view for distinct pairs of a context (the keys of OM) and an action."""
    keys = VIEW_LEVELS["OM"][-1]
    chains = {f"_p_{v}": levels for v, levels in VIEW_LEVELS.items()}
    look = eb_views(count_cells(train, keys), pairs, chains, STUDY.shrink)
    return look.select(*keys, "family", *[
        log_loss_of(F.col(f"_p_{v}"), F.col("family")).alias(f"loss_{v.lower()}") for v in VIEW_LEVELS])


# ---------------------------------------------------------------- SQL side

FAMS = """fams(fi, fam) AS (VALUES (1,'FF'),(2,'SI'),(3,'FC'),(4,'SL'),(5,'CU'),(6,'CH'),(7,'FS'),(8,'XX'))"""
STUDY_SQL = f"""{MIX},
study AS (SELECT d.*, coalesce(lag(family) OVER w, '^') AS prev_family, coalesce(lag(family,2) OVER w, '^') AS prev2_family,
    coalesce(lag(family,3) OVER w, '^') AS prev3_family, lag(release_speed) OVER w AS prev_release_speed,
    lag(outcome) OVER w AS prev_outcome, lag(plate_x_br) OVER w AS prev_plate_x_br,
    lag(plate_z_norm) OVER w AS prev_plate_z_norm, lag(release_pos_x) OVER w AS prev_release_pos_x,
    coalesce(string_agg(family,'>') OVER p, '') AS history_text,
    coalesce(array_to_string(list_sort(list(family) OVER p), '+'), '') AS multiset,
    concat_ws('>', {', '.join(f"lag(family,{d}) OVER w" for d in range(STUDY.markov_depth, 0, -1))}) AS recent,
    CAST(dense_rank() OVER (PARTITION BY game_pk, pitcher, batter ORDER BY at_bat_number) > 1 AS INT) AS met,
    hist_n, {', '.join(f'n_{f} >= {STUDY.min_count} AND coalesce(mix_{f},0) >= {STUDY.min_share} AS ok_{f}' for f in ('ff', 'si', 'fc', 'sl', 'cu', 'ch', 'fs', 'xx'))},
    fld_score - bat_score AS score_diff_pitcher,
    CASE WHEN outcome <> 'other' THEN outcome IN ('whiff','foul','in_play') END AS node_swing,
    CASE WHEN outcome IN ('ball','called_strike') THEN outcome = 'called_strike' END AS node_called_strike,
    CASE WHEN outcome IN ('whiff','foul','in_play') THEN outcome END AS node_contact
  FROM dec d LEFT JOIN mixed USING (pitcher, game_date)
  WINDOW w AS (PARTITION BY pa_id ORDER BY pitch_number),
    p AS (PARTITION BY pa_id ORDER BY pitch_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
train AS (SELECT * FROM study WHERE {TRAIN}),
held AS (SELECT * FROM study WHERE {HELD_OUT}),
{FAMS}"""


def chain_sql(name: str, levels: list[list[str]], k: float = STUDY.shrink, contexts: str = "held",
              source: str = "train", action: str = "family", fams: str = "fams") -> str:
    """`<name>(finest keys, fi, fam, n, nn, p)`: the shrink chain in long form."""
    ctes = [f"{name}_0 AS (SELECT fi, fam, ((SELECT count(*) FROM {source} WHERE {action}=fam) + 1.0::DOUBLE/(SELECT count(*) FROM {fams}))/(1 + (SELECT count(*) FROM {source} WHERE {action} IS NOT NULL)) AS p FROM {fams})"]
    joins, p = [], "b.p"
    for i, keys in enumerate(levels):
        ks = ", ".join(keys)
        ctes.append(f"{name}_n{i} AS (SELECT {ks}, {action} AS fam, count(*) AS n FROM {source} WHERE {action} IS NOT NULL GROUP BY ALL)")
        ctes.append(f"{name}_t{i} AS (SELECT {ks}, sum(n) AS nn FROM {name}_n{i} GROUP BY ALL)")
        joins.append(f"LEFT JOIN {name}_n{i} a{i} ON {' AND '.join(f'a{i}.{x}=c.{x}' for x in keys)} AND a{i}.fam=b.fam "
                     f"LEFT JOIN {name}_t{i} t{i} ON {' AND '.join(f't{i}.{x}=c.{x}' for x in keys)}")
        # a cell with its parent's rows and no others adds nothing
        own = f"coalesce(t{i}.nn,0) <> {f'coalesce(t{i - 1}.nn,0)' if i else '-1'}"
        p = f"((CASE WHEN {own} THEN coalesce(a{i}.n,0) ELSE 0 END+{k}*{p})/(CASE WHEN {own} THEN coalesce(t{i}.nn,0) ELSE 0 END+{k}))"
    last = len(levels) - 1
    ks = ", ".join(levels[-1])
    ctes.append(f"{name} AS (SELECT c.*, b.fi, b.fam, CAST(coalesce(a{last}.n,0) AS BIGINT) AS n, "
                f"CAST(coalesce(t{last}.nn,0) AS BIGINT) AS nn, {p} AS p "
                f"FROM (SELECT DISTINCT {ks} FROM {contexts}) c CROSS JOIN {name}_0 b {' '.join(joins)})")
    return ",\n".join(ctes)


def pred_sql(views=("C", "L1")) -> str:
    """`pred`: held-out rows x view x family; `scored`: one row per view with its losses."""
    chains = [chain_sql(f"v{v}".lower(), VIEW_LEVELS[v]) for v in views]
    long = " UNION ALL ".join(
        f"SELECT h.*, '{v}' AS state_view, x.fi, x.fam, x.p FROM held h JOIN v{v.lower()} x USING ({', '.join(VIEW_LEVELS[v][-1])})"
        for v in views)
    return ",\n".join(chains) + f""",
pred AS ({long}),
hits AS (SELECT *, max(CASE WHEN fam=family THEN p END) OVER (PARTITION BY row_id, state_view) AS pa FROM pred),
scored AS (SELECT row_id, state_view, any_value(family) AS family, any_value(pitcher) AS pitcher, any_value(game_pk) AS game_pk,
    any_value(season) AS season, any_value(pitch_number) AS pitch_number, any_value(balls) AS balls,
    any_value(strikes) AS strikes, any_value(hist_n) AS hist_n, -ln(greatest(any_value(pa), 1e-12)) AS loss,
    sum(p*p) - 2*any_value(pa) + 1 AS brier, 1 + count(*) FILTER (p > pa) AS rank,
    arg_min(fam, struct_pack(a := -p, b := fi)) AS guess
  FROM hits GROUP BY 1, 2)"""


SLICED = "SELECT * FROM (SELECT *, unnest([{}]) AS slice FROM {{src}}) WHERE slice IS NOT NULL".format(", ".join(
    f"CASE WHEN {w} THEN '{s}' END" for s, w in [
        ("all", "true"), ("seq_eligible", "pitch_number>=2"), ("long_pa", "pitch_number>=3"),
        ("two_strike", "strikes=2"), ("three_ball", "balls=3"), ("first_pitch", "pitch_number=1")]))


def sliced(src: str) -> str:
    return SLICED.format(src=src)
