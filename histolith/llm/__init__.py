"""Operators for large training corpora: vectors, terms, sketches, clusters, tokens, packing, quality."""
