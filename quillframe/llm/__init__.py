"""Operators for large-scale training-data preparation.

Nothing outside this folder imports it.  ``catalog`` holds the registered
queries and their SQL; every other module holds one operator.
"""
