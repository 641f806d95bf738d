"""Operators for large text corpora: packing, token files, deduplication, extraction, identification, search, quality.

Nothing outside this package imports it. Each module holds one operator with a general interface; ``queries``
binds them to the tables of a directory.
"""
