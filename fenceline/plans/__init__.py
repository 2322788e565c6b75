"""Whole commands as plans: check, update, and the tables they start from."""
