"""The registered queries."""

from . import changes, evidence, graph, lists, merge, payload

QUERIES = graph.QUERIES
ORACLE_SQL = graph.ORACLE_SQL
__all__ = ["ORACLE_SQL", "QUERIES", "changes", "evidence", "lists", "merge", "payload"]
