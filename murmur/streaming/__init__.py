"""Structured Streaming forms of the ingest and matrix operators."""
