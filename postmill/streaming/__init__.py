"""Structured Streaming forms of the ingest: the drop folder and the running state."""
