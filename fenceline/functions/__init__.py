"""Column functions: names, paths, digests, texts."""
