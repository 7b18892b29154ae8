"""Incremental digest cache over micro-batches."""
