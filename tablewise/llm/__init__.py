"""Operators for text corpora: deduplication, token counts, scans, scoring, filtering, mixing and sharding."""
