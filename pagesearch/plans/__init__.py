"""Composed jobs (ingest, index build, search batch) and the query catalog."""
