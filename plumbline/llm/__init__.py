"""Operators of a training-data pipeline and their named queries.

Nothing else in the library imports this subpackage.
"""
