"""Bi-temporal knowledge-graph analytics as Spark DataFrame jobs."""
