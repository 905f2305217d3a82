"""Corpus operators: near-duplicates, repeated text, quality, sharding, archives, mixing and tokens.

Each module holds one operator as functions over DataFrames; ``queries`` applies them to the supplied
tables. Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
