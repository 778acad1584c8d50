"""All queries of this subpackage, with their SQL where SQL can say it."""

from assayloom.llm import compound_queries, document_queries, fingerprint_queries, pool_queries

_PARTS = [compound_queries, pool_queries, document_queries, fingerprint_queries]
QUERIES = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
SQL = {k: s for p in _PARTS for k, s in p.SQL.items()}
