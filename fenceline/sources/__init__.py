"""Readers and writers: source trees, package files, records, caches."""
