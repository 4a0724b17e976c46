"""Training-data operators: deduplication, filtering, scoring, mixing, packing.

Nothing else in the library imports this subpackage; ``queries`` registers one
query per operator and ``corpus_pipeline`` (repository top) chains five of them.
"""
