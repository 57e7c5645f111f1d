"""Structured Streaming variants (extensions: the operators themselves are batch)."""
