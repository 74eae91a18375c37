"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage; its queries are listed in
``rookery.llm.registry`` and only the repository's entry module looks for it.
"""
