"""Structured Streaming forms of the counters, the limiter and the incremental upsert."""
