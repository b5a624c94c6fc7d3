"""Incremental ingestion, statistics and query metrics on Structured Streaming."""
