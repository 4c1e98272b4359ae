"""Operators that prepare text for language-model training.

Nothing outside this folder imports it. The queries over the shared test tables
are in :mod:`tagweft.llm.catalogue`.
"""
