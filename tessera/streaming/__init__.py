"""Structured Streaming: counts, global dedup, sharded flushes, telemetry windows."""
