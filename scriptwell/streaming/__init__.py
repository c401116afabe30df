"""Structured Streaming: claim decoding, routing, alerting and sinks."""
