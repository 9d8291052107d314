"""Corpus preparation for language-model training: scoring, tokenising, filtering, deduplication and packing.

Nothing outside this subpackage imports it; ``queries.py`` holds its registered queries.
"""
