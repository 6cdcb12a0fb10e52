"""Summaries and the query catalogue."""
