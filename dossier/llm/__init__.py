"""Operators for preparing language-model training data at scale.

Nothing outside this folder imports it. ``queries.py`` registers the queries.
"""
