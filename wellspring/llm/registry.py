"""All queries of the subpackage and their SQL."""

from . import queries_audit, queries_corpus, queries_pack, queries_text

_MODULES = (queries_pack, queries_text, queries_corpus, queries_audit)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
