"""Operators for large training-data pipelines, each built by a named method."""
