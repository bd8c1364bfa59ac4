"""All registered queries of the bar engine and the SQL that gives the same rows."""

from __future__ import annotations

from barspark.plans import bar_queries, desk_queries, feature_queries, fitted_queries, model_queries

QUERIES: dict = {}
ORACLE: dict = {}
for _module in (bar_queries, feature_queries, desk_queries, model_queries, fitted_queries):
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
