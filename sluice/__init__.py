"""Sluice: quality gates, diffs and gate statistics over tables, on Spark."""
