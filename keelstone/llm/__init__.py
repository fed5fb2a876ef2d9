"""Training-data operators: dedup, decontamination, classification, privacy, tokens, shards.

Nothing else in the package imports this one. Every operator is a function of DataFrames;
``catalog`` applies them to the given tables.
"""
