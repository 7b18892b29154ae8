"""Grouping, ranking and keep/drop operators."""
