"""Continuous ingest and continuously kept state."""
