"""Compositions of operators over the driver tables, and the query registry."""
