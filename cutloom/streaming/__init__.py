"""Streaming twins of the sequence operators."""
