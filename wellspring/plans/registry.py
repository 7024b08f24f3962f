"""All queries of the library proper and their SQL."""

from . import column_queries, core_queries, io_queries, model_queries

_MODULES = (column_queries, core_queries, io_queries, model_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
