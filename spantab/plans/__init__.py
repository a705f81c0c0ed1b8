"""Whole plans over the given tables: the proxy view, the registered queries and their SQL twins."""
