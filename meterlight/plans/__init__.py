"""Operator chains: the feature table, model training and the report queries."""
