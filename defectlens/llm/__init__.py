"""Operators of a training-data pipeline: one module per operator.

Nothing outside this folder imports it.  ``queries.py`` registers one query
per operator; the modules hold the general operators.
"""
