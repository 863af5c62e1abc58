"""Operators for large-scale training-data pipelines: dedup, joins, scoring, filtering, mixing, packing.

Nothing outside this subpackage imports it.
"""
