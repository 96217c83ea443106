"""Scans: stored tables, the source registry, and parsers of landed payloads."""
