"""Operators for large-scale training-data pipelines.

Self-contained: nothing outside this subpackage imports it.
"""
