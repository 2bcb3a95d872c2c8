"""Structured Streaming forms of the ingest and daily operators."""
