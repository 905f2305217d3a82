"""Incremental forms of the ingest and usage jobs on Structured Streaming."""
