"""Registry of the queries over the driver's tables."""

from recallgrid.plans import q_edits, q_graph, q_recall, q_sources, q_streams, q_text
from recallgrid.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "q_edits", "q_graph", "q_recall", "q_sources", "q_streams", "q_text"]
