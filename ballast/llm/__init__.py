"""Operators for preparing training data.

Nothing else in the package imports this subpackage. Every operator takes and returns
DataFrames; ``ballast.llm.queries`` runs each of them on the test tables.
"""
