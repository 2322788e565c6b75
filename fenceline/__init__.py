"""Boundary analytics for large code bases, and preparation of training text, as Spark jobs."""
