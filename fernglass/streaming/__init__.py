"""Continuous ingestion, an extension."""
