"""Training-data operators: sharding, secret scans, mixing, byte-pair encoding, media columns,
nearest neighbours, near-duplicates, quality scores, page text, token counts, periodic runs, chat
examples and Merkle manifests.

Nothing else in the library imports this subpackage.
"""
