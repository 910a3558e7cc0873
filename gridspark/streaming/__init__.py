"""Continuous ingestion of monthly files."""
