"""Relational operators: rules, baseline, resolution, graph, usage."""
