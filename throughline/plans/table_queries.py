"""Queries over section E: count tables, baselines, grammar."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from throughline.config import EVENT_TYPES, FAMILIES, FAMILY_CODES
from throughline.operators import decision, history, tables
from throughline.plans.common import STUDY, TRAIN, Query, rounded, spread, table
from throughline.plans.oracle import r6 as q6, sql
from throughline.plans.study import START, STUDY_SQL, chain_sql, study_rows, train_and_held
from throughline.sources.adapter import user_event_log

K = STUDY.shrink
LOW = [f.lower() for f in FAMILIES]


def base_freq(spark, path):
    t = tables.base_freq(train_and_held(spark, path)[0])
    return t.select("count_state", "stand", "p_throws", "n", *spread("probs"))


def shrunk_pitcher_count(spark, path):
    t = tables.shrunk_pitcher_count(train_and_held(spark, path)[0], K)
    return t.select("pitcher", "count_state", "n", *spread("probs"))


def first_order(spark, path):
    train = train_and_held(spark, path)[0].filter("pitch_number >= 2")
    return tables.first_order(train, K).select("prev_family", "n", *spread("probs"))


def pitcher_count_prev(spark, path):
    t = tables.pitcher_count_prev(train_and_held(spark, path)[0], K)
    return t.select("pitcher", "count_state", "prev_family", "n", *spread("probs"))


SELECTION = [["count_state"], ["count_state", "stand", "p_throws"],
             ["count_state", "stand", "p_throws", "pitcher"]]


def eb_selection(spark, path):
    t = tables.eb_selection(train_and_held(spark, path)[0], SELECTION, K)
    return t.select(*SELECTION[-1], "n", *spread("probs"))


VALUE = [["family"], ["family", "count_state"], ["family", "count_state", "pitcher"]]


def eb_run_value(spark, path):
    t = tables.eb_run_value(train_and_held(spark, path)[0], VALUE, K)
    return rounded(t, "raw_mean", "mean", "sd")


SUPPORT = {"count": ["count_state"], "pitcher_count": ["pitcher", "count_state"],
           "pitcher_count_prev": ["pitcher", "count_state", "prev_family"],
           "pair": ["pitcher", "batter"], "ordered": ["pitcher", "count_state", "recent"]}


def support_table(spark, path):
    return tables.support_table(train_and_held(spark, path)[0], SUPPORT)


def markov_backoff(spark, path):
    t = tables.markov_backoff(train_and_held(spark, path)[0], STUDY.markov_depth, K)
    return rounded(t, "p", "sd")


def order_patterns(spark, path):
    rows = study_rows(spark, path)
    parts = [tables.order_patterns(rows, n) for n in (2, 3)]
    return rounded(parts[0].unionByName(parts[1]), "expected", "lift")


def _events(spark, path):
    """The user-event log with the same context columns as the pitch rows."""
    return history.chunked_lags(user_event_log(spark, path), ["user_id", "day"], "minute",
                                ["ts", "event_id"], "event_type", 2, START)


def events_first_order(spark, path):
    t = tables.first_order(_events(spark, path), K, "event_type", EVENT_TYPES)
    return t.select("prev_family", "n", *spread("probs", "p", EVENT_TYPES))


def events_markov(spark, path):
    return rounded(tables.markov_backoff(_events(spark, path), 2, K, "event_type", EVENT_TYPES), "p", "sd")


def events_order_patterns(spark, path):
    return rounded(tables.order_patterns(_events(spark, path), 3, "event_type", "seq"), "expected", "lift")


# The exact codes as alphabet: the second benchmark beside the families.
CODES = [x for codes in FAMILY_CODES.values() for x in codes] + ["null", "ZZ"]


def pitch_type_first_order(spark, path):
    w = W.partitionBy("game_pk", "at_bat_number").orderBy("pitch_number")
    df = decision.action_column(table(spark, path), "pitch_type")
    df = df.withColumn("prev_family", F.coalesce(F.lag("action").over(w), F.lit(START)))
    t = tables.first_order(df.filter(TRAIN), K, "action", CODES)
    return t.select("prev_family", "n", *spread("probs", "p", CODES))


# ---------------------------------------------------------------- SQL side

def wide_sql(src: str, keys: list[str], names=FAMILIES, p: str = "p") -> str:
    cols = ", ".join(f"{q6(f'max(CASE WHEN fam=' + chr(39) + f + chr(39) + f' THEN {p} END)')} AS p_{f.lower()}" for f in names)
    return f"SELECT {', '.join(keys)}, any_value(nn) AS n, {cols} FROM {src} GROUP BY {', '.join(keys)}"


E1 = """eroot AS (SELECT fi, fam, ((SELECT count(*) FROM train WHERE family=fam) + 1.0::DOUBLE/8)/(1 + (SELECT count(*) FROM train)) AS rp FROM fams),
e1 AS (SELECT count_state, stand, p_throws, fi, fam, nn, ((SELECT count(*) FROM train x WHERE x.count_state=c.count_state AND x.stand=c.stand AND x.p_throws=c.p_throws AND x.family=fam) + rp)/(nn + 1) AS p
  FROM (SELECT count_state, stand, p_throws, count(*) AS nn FROM train GROUP BY ALL) c CROSS JOIN eroot)"""
E2 = f"""{E1},
e2h AS (SELECT pitcher, count_state, stand, p_throws, count(*) AS m FROM train GROUP BY ALL),
e2p AS (SELECT pitcher, count_state, fi, fam, sum(m*p)/sum(m) AS parent, CAST(sum(m) AS BIGINT) AS nn
  FROM e2h JOIN e1 USING (count_state, stand, p_throws) GROUP BY 1,2,3,4),
e2n AS (SELECT pitcher, count_state, family AS fam, count(*) AS n FROM train GROUP BY ALL),
e2 AS (SELECT pitcher, count_state, fi, fam, nn, (coalesce(n,0)+{K}*parent)/(nn+{K}) AS p
  FROM e2p LEFT JOIN e2n USING (pitcher, count_state, fam))"""
E4 = f"""{E2},
e4c AS (SELECT pitcher, count_state, prev_family, count(*) AS nn FROM train GROUP BY ALL),
e4n AS (SELECT pitcher, count_state, prev_family, family AS fam, count(*) AS n FROM train GROUP BY ALL),
e4 AS (SELECT pitcher, count_state, prev_family, fam, e4c.nn, (coalesce(n,0)+{K}*p)/(e4c.nn+{K}) AS p
  FROM e4c JOIN e2 USING (pitcher, count_state) LEFT JOIN e4n USING (pitcher, count_state, prev_family, fam))"""


def _run_value_sql() -> str:
    ctes = ["seen AS (SELECT * FROM train WHERE reward IS NOT NULL)",
            "g AS (SELECT avg(reward) AS m, var_samp(reward) AS v FROM seen)"]
    p = "g.m"
    joins = ""
    for i, keys in enumerate(VALUE):
        ks = ", ".join(keys)
        ctes.append(f"r{i} AS (SELECT {ks}, count(*) AS n{i}, sum(reward) AS s{i} FROM seen GROUP BY ALL)")
        p = f"((s{i}+{K}*{p})/(n{i}+{K}))"
        if i < len(VALUE) - 1:
            joins += f" JOIN r{i} USING ({ks})"
    last = len(VALUE) - 1
    body = (f"SELECT {', '.join(VALUE[-1])}, n{last} AS n, {q6(f's{last}/n{last}')} AS raw_mean, {q6(p)} AS mean, "
            f"{q6(f'sqrt(g.v/(n{last}+{K}))')} AS sd FROM r{last}{joins}, g")
    return sql(body, STUDY_SQL, *ctes)


def _support_sql() -> str:
    parts = []
    for name, keys in SUPPORT.items():
        parts.append(f"""SELECT '{name}' AS level, CAST(CASE WHEN s>=100 THEN 100 WHEN s>=50 THEN 50 WHEN s>=20 THEN 20 WHEN s>=10 THEN 10 WHEN s>=5 THEN 5 WHEN s>=2 THEN 2 ELSE 1 END AS INT) AS size_from,
  count(*) AS n_cells, CAST(sum(s) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN s<50 THEN s ELSE 0 END) AS BIGINT) AS n_thin
  FROM (SELECT {', '.join(keys)}, count(*) AS s FROM train GROUP BY ALL) GROUP BY ALL""")
    return sql(" UNION ALL ".join(parts), STUDY_SQL)


def _markov_sql(depth: int, base: list[str], source: str, action: str, fams: str, log=None) -> str:
    names = [f"prev{'' if d == 1 else d}_family" for d in range(1, depth + 1)]
    ctes, parts = list(base), []
    for d in range(depth + 1):
        if d == 0:
            ctes.append(chain_sql("mk0", [names[:1]], K, source, source, action, fams))
            parts.append(f"SELECT 0 AS depth, '' AS context, (SELECT count(*) FROM {source}) AS n_context, fam AS action, "
                         f"(SELECT count(*) FROM {source} WHERE {action}=fam) AS n, p FROM mk0_0")
        else:
            ctes.append(chain_sql(f"mk{d}x", [names[:j] for j in range(1, d + 1)], K, source, source, action, fams))
            parts.append(f"SELECT {d}, concat_ws('>', {', '.join(reversed(names[:d]))}), nn, fam, n, p FROM mk{d}x")
    body = (f"SELECT depth, context, n_context, action, n, {q6('p')} AS p, "
            f"{q6(f'sqrt(p*(1-p)/(n_context+{K}+1))')} AS sd FROM ({' UNION ALL '.join(parts)})")
    return sql(body, *ctes) if log is None else sql(body, *ctes, log=log)


def _patterns_sql(n: int, source: str, action: str, order: str) -> str:
    names = [f"prev{'' if d == 1 else d}_family" for d in range(n - 1, 0, -1)] + [action]
    joins = " ".join(f"JOIN m{n} s{i} ON s{i}.a=g.{x}" for i, x in enumerate(names))
    e = f"(SELECT sum(n) FROM g{n})::DOUBLE*" + "*".join(f"s{i}.share" for i in range(len(names)))
    return (f"SELECT concat_ws('>', {', '.join('g.' + x for x in names)}) AS pattern, g.n, {q6(e)} AS expected, "
            f"{q6(f'g.n/({e})')} AS lift FROM g{n} g {joins}",
            f"g{n} AS (SELECT {', '.join(names)}, count(*) AS n FROM {source} WHERE {order} >= {n} GROUP BY ALL)",
            f"m{n} AS (SELECT {action} AS a, count(*)/(SELECT count(*) FROM {source}) AS share FROM {source} GROUP BY 1)")


_P2 = _patterns_sql(2, "study", "family", "pitch_number")
_P3 = _patterns_sql(3, "study", "family", "pitch_number")
EVENT_LOG = """ev AS (SELECT *, coalesce(lag(event_type) OVER w, '^') AS prev_family, coalesce(lag(event_type,2) OVER w, '^') AS prev2_family,
    row_number() OVER w AS seq
  FROM (SELECT *, CAST(ts AS DATE) AS d FROM events) WINDOW w AS (PARTITION BY user_id, d ORDER BY ts, event_id)),
evs(fi, fam) AS (VALUES (1,'click'),(2,'error'),(3,'purchase'),(4,'signup'),(5,'view'))"""
_PE = _patterns_sql(3, "ev", "event_type", "seq")

QUERIES = {
    "base_freq": Query(base_freq, sql(wide_sql("e1", ["count_state", "stand", "p_throws"]), STUDY_SQL, E1)),
    "shrunk_pitcher_count": Query(shrunk_pitcher_count, sql(wide_sql("e2", ["pitcher", "count_state"]), STUDY_SQL, E2)),
    "first_order": Query(first_order, sql(
        wide_sql("fo", ["prev_family"]), STUDY_SQL, "tr2 AS (SELECT * FROM train WHERE pitch_number>=2)",
        chain_sql("fo", [["prev_family"]], K, "tr2", "tr2"))),
    "pitch_type_first_order": Query(pitch_type_first_order, sql(
        wide_sql("pt", ["prev_family"], CODES),
        f"codes(fi, fam) AS (VALUES {', '.join(f'({i}, {chr(39)}{x}{chr(39)})' for i, x in enumerate(CODES, 1))})",
        "pta AS (SELECT season, pa_id, pitch_number, coalesce(pitch_type,'null') AS act FROM dec)",
        f"ptt AS (SELECT * FROM (SELECT *, coalesce(lag(act) OVER (PARTITION BY pa_id ORDER BY pitch_number), '^') AS prev_family FROM pta) WHERE {TRAIN})",
        chain_sql("pt", [["prev_family"]], K, "ptt", "ptt", "act", "codes"))),
    "pitcher_count_prev": Query(pitcher_count_prev, sql(
        wide_sql("e4", ["pitcher", "count_state", "prev_family"]), STUDY_SQL, E4)),
    "eb_selection": Query(eb_selection, sql(
        wide_sql("eb", SELECTION[-1]), STUDY_SQL, chain_sql("eb", SELECTION, K, "train"))),
    "eb_run_value": Query(eb_run_value, _run_value_sql()),
    "support_table": Query(support_table, _support_sql()),
    "markov_backoff": Query(markov_backoff, _markov_sql(3, [STUDY_SQL], "train", "family", "fams")),
    "order_patterns": Query(order_patterns, sql(
        f"{_P2[0]} UNION ALL {_P3[0]}", STUDY_SQL, _P2[1], _P2[2], _P3[1], _P3[2])),
    "events_first_order": Query(events_first_order, sql(
        wide_sql("fo", ["prev_family"], EVENT_TYPES),
        chain_sql("fo", [["prev_family"]], K, "ev", "ev", "event_type", "evs"), log=EVENT_LOG)),
    "events_markov": Query(events_markov, _markov_sql(2, [], "ev", "event_type", "evs", EVENT_LOG)),
    "events_order_patterns": Query(events_order_patterns, sql(_PE[0], _PE[1], _PE[2], log=EVENT_LOG)),
}
