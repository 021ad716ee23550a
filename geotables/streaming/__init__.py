"""Structured Streaming: the stateless operators run on streaming DataFrames unchanged."""
