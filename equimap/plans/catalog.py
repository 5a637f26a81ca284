"""The reference operators' queries, by name, and SQL that gives the same rows."""

from __future__ import annotations

from . import access_queries, evaluation_queries, model_queries, planning_queries, polygon_queries, region_queries, scalar_queries, spatial_queries, stat_queries, text_queries

_MODULES = (scalar_queries, stat_queries, spatial_queries, text_queries, model_queries, planning_queries, evaluation_queries, region_queries, polygon_queries, access_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.Q.queries.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.Q.sql.items()}
