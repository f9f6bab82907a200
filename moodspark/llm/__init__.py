"""Training-data operators: fingerprints, tokenizing, licences, language, quality,
near-duplicate joins, vector search, line and passage dedup, mixing.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
