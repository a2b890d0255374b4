"""Diffs, joins, gates, statistics and graph operators: DataFrames in, DataFrames out."""
