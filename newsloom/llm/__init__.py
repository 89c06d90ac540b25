"""Operators for large training-data pipelines, independent of the rest of the library."""
