"""Operators for building training corpora (packing, fingerprints, mixing,
quality, language, deduplication, personal data, toxicity).

Nothing else in the library imports this subpackage; ``queries.QUERIES`` and
``queries.SQL`` hold its registered queries.
"""
