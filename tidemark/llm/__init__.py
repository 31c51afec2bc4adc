"""Operators for preparing large text and vector corpora.

Nothing outside this folder imports it; its queries are in ``queries``.
"""
