"""twinsieve: exact-duplicate analytics over file trees and document tables, on Spark DataFrames."""

__version__ = "0.1.0"
