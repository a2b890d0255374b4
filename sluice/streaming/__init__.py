"""Ordered folds over attempt streams."""
