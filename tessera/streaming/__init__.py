"""Structured Streaming forms of ingest and session memory."""
