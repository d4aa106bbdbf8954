"""Structured Streaming: ingest, sliding meters, the rate limiter."""
