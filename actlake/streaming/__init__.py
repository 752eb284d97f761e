"""Incremental forms of the jobs with Structured Streaming."""
