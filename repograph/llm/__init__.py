"""Operators for building training corpora (dedup, language ID, packing, archives, ...).

Each module holds one operator with its own general interface; ``queries.py`` holds the
registered queries derived from them. Nothing outside this package imports it.
"""
