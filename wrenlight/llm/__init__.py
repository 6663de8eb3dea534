"""Operators for building training data, each with a query over the given tables."""
