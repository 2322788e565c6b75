"""Incremental checking as a stream."""
