"""Operators for preparing training text at cluster scale.

Nothing else in the library imports this subpackage; the queries and their SQL
are in :mod:`morphspark.llm.queries`.
"""
