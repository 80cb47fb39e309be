"""Whole plans: graphs from tables and records, schema compiler, pattern queries, and the query catalogue."""
