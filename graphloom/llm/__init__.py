"""Operators for large training-data pipelines; optional, nothing outside this subpackage imports it."""
