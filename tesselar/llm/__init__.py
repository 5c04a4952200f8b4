"""Operators of a training-data pipeline.

Nothing outside this package imports it.  ``queries`` lists the registered
queries and ``oracle`` their DuckDB equivalents.
"""
