"""Fixtures over the given tables, and the registered queries."""
