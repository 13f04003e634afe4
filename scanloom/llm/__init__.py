"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage; its queries and oracle
SQL are in :mod:`scanloom.llm.queries`.
"""
