"""Operators for preparing training corpora.

Nothing outside this package imports it; ``queries.py`` holds what the entry point registers.
"""
