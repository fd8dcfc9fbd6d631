"""Structured Streaming variants: live usage, live crash detection, live GPU state."""
