"""Structured Streaming: ingest, rollups, late rows, liveness, smoother state."""
