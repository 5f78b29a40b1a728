"""Composed plans: the registered driver queries and size probes."""
