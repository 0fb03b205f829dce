"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it; ``queries.py`` registers its
queries and ``oracles.py`` their SQL.
"""
