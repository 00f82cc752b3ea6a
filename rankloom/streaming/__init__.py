"""Structured Streaming forms of the telemetry, feature-refresh and drift operators."""
