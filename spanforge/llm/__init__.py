"""Training-data operators: language, quality, toxicity, deduplication, formatting, search and scoring.

Nothing outside this subpackage imports it; ``registry`` lists its queries for ``__spark_entry__``.
"""
