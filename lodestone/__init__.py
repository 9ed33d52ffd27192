"""Ranked, budget-aware retrieval and analytics over text, graphs, vectors and events, as Spark DataFrame functions."""
