"""Scalar functions: packed sizes, codecs, hashes, identifiers."""
