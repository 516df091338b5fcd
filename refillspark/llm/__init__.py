"""Operators on text corpora: tokens, duplicates, personal data, classifiers, shards and search.

Nothing outside this package imports it. Every operator is a function from DataFrames to a
DataFrame; ``queries`` holds the thin registered queries.
"""
