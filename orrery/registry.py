"""All registered queries and their SQL forms, by name."""

from __future__ import annotations

from orrery.plans import q_core, q_graph, q_more, q_ops, q_stream, q_text

QUERIES = q_core.QUERIES | q_text.QUERIES | q_graph.QUERIES | q_stream.QUERIES | q_more.QUERIES | q_ops.QUERIES
SQL = q_core.SQL | q_text.SQL | q_graph.SQL | q_stream.SQL | q_more.SQL | q_ops.SQL
