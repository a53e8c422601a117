"""Structured Streaming ingest of mesh edits."""
