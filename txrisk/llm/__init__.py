"""Operators of a training-data pipeline, one module each, and their queries.

Nothing else in the library imports this package.
"""
