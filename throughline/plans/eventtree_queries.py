"""Queries over F2 and G12: the composed event tree and the final event's scores."""

from __future__ import annotations

from throughline.operators import eventtree
from throughline.plans.common import Query, rounded
from throughline.plans.oracle import r6 as q6, sql
from throughline.plans.policy_queries import K
from throughline.plans.study import STUDY_SQL, train_and_held

KEYS = ["count_state", "family"]
LEVELS = [["count_state"], KEYS]


def _leaves(train, held):
    return eventtree.leaf_probabilities(train, held.select(*KEYS), LEVELS, K)


def event_tree_leaves(spark, path):
    return rounded(_leaves(*train_and_held(spark, path)), "p")


def event_tree_scores(spark, path):
    train, held = train_and_held(spark, path)
    return rounded(eventtree.final_event_scores(held, _leaves(train, held), KEYS, ["season"]), "log_loss", "brier")


LEAF = """CASE WHEN outcome IN ('ball','called_strike','whiff','foul') THEN outcome
    WHEN outcome='in_play' THEN 'in_play:'||coalesce(events,'(none)') END"""
TREE_SQL = f"""lt AS (SELECT count_state, family, {LEAF} AS leaf FROM train WHERE outcome<>'other'),
lh AS (SELECT season, count_state, family, {LEAF} AS leaf FROM held WHERE outcome<>'other'),
leaves AS (SELECT DISTINCT leaf FROM (SELECT leaf FROM lt UNION ALL SELECT unnest(['ball','called_strike','whiff','foul','in_play:(unseen)']))),
steps AS (SELECT leaf, 'swing' AS node, CASE WHEN leaf IN ('ball','called_strike') THEN 'take' ELSE 'swing' END AS branch FROM leaves
  UNION ALL SELECT leaf, CASE WHEN leaf IN ('ball','called_strike') THEN 'take' ELSE 'contact' END, CASE WHEN leaf LIKE 'in_play:%' THEN 'in_play' ELSE leaf END FROM leaves
  UNION ALL SELECT leaf, 'in_play', leaf FROM leaves WHERE leaf LIKE 'in_play:%'),
br AS (SELECT count_state, family, node, branch, count(*) AS n FROM lt JOIN steps USING (leaf) GROUP BY 1,2,3,4),
wide AS (SELECT node, count(DISTINCT branch) AS b FROM steps GROUP BY 1),
ctx AS (SELECT DISTINCT count_state, family FROM held),
edge AS (SELECT DISTINCT count_state, family, node, branch FROM ctx CROSS JOIN steps),
cnt AS (SELECT e.*, b,
    coalesce((SELECT sum(n) FROM br WHERE br.node=e.node AND br.branch=e.branch),0) AS n0, coalesce((SELECT sum(n) FROM br WHERE br.node=e.node),0) AS t0,
    coalesce((SELECT sum(n) FROM br WHERE br.node=e.node AND br.branch=e.branch AND br.count_state=e.count_state),0) AS n1,
    coalesce((SELECT sum(n) FROM br WHERE br.node=e.node AND br.count_state=e.count_state),0) AS t1,
    coalesce((SELECT sum(n) FROM br WHERE br.node=e.node AND br.branch=e.branch AND br.count_state=e.count_state AND br.family=e.family),0) AS n2,
    coalesce((SELECT sum(n) FROM br WHERE br.node=e.node AND br.count_state=e.count_state AND br.family=e.family),0) AS t2
  FROM edge e JOIN wide USING (node)),
shr AS (SELECT count_state, family, node, branch, (n2 + {K}*(n1 + {K}*(n0 + 1.0::DOUBLE/b)/(t0 + 1))/(t1 + {K}))/(t2 + {K}) AS p FROM cnt),
dist AS (SELECT s.count_state, s.family, leaf, product(s.p) AS p FROM shr s JOIN steps USING (node, branch) GROUP BY 1,2,3)"""

QUERIES = {
    "event_tree_leaves": Query(event_tree_leaves, sql(f"SELECT count_state, family, leaf, {q6('p')} AS p FROM dist", STUDY_SQL, TREE_SQL)),
    "event_tree_scores": Query(event_tree_scores, sql(
        f"SELECT season, count(*) AS n, {q6('avg(-ln(d.p))')} AS log_loss, {q6('avg(sq - 2*d.p + 1)')} AS brier FROM "
        "(SELECT season, count_state, family, CASE WHEN leaf IN (SELECT leaf FROM leaves) THEN leaf ELSE 'in_play:(unseen)' END AS leaf FROM lh) h "
        "JOIN dist d USING (count_state, family, leaf) JOIN (SELECT count_state, family, sum(p*p) AS sq FROM dist GROUP BY 1,2) USING (count_state, family) GROUP BY 1",
        STUDY_SQL, TREE_SQL)),
}
