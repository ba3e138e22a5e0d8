"""Operators over training text: tokens, duplicates, scores, mixes, vectors.

Nothing outside this subpackage imports it.
"""
