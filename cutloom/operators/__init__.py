"""Relational, sequence, interval and vector operators (DataFrame in, DataFrame out)."""
