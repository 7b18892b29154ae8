"""Scalar functions as Columns: paths, sizes, patterns, digests."""
