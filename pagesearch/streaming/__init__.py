"""Structured Streaming jobs: change ticks, incremental ingest and index."""
