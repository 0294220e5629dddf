"""Every registered query, by name."""

from __future__ import annotations

from throughline.plans import (
    crossfit_queries, eventtree_queries, falsify_queries, history_queries, landing_queries, metric_queries, model_queries,
    policy_queries, predict_queries, table_queries,
)
from throughline.plans.common import Query

CATALOG: dict[str, Query] = {
    **landing_queries.QUERIES,
    **history_queries.QUERIES,
    **table_queries.QUERIES,
    **metric_queries.QUERIES,
    **falsify_queries.QUERIES,
    **policy_queries.QUERIES,
    **predict_queries.QUERIES,
    **model_queries.QUERIES,
    **crossfit_queries.QUERIES,
    **eventtree_queries.QUERIES,
}
