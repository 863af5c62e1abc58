"""Operators over points, cells, objects and frames. Each takes and returns DataFrames; none collects."""
