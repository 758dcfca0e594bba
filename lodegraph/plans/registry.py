"""All queries of the engine's own operators with their oracles."""

from lodegraph.plans import code_queries, evolution_queries, graph_queries, mechanism_queries, mining_queries, version_queries

_PARTS = (code_queries, evolution_queries, graph_queries, version_queries, mining_queries, mechanism_queries)
QUERIES = {k: f for m in _PARTS for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in _PARTS for k, q in m.ORACLES.items()}
