"""Operators for large training-data pipelines (token counts, deduplication, packing, ...)."""
