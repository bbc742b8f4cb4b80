"""Training-data operators: language, extraction, tokens, duplicates, leaks, toxicity, shards.

Every module here stands alone: nothing else in ``dumploom`` imports this subpackage.
Each operator takes and returns DataFrames and documents what it does with nulls,
empty texts, repeated rows, empty tables and unknown extra columns (which it ignores).
"""
