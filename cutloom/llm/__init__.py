"""Operators for training data: vectors, clusters, turns, runs, tokens, leaks, subjects."""
