"""Training-data operators: dedup, quality, extraction, tokens, packing.

Nothing outside this subpackage imports it. ``queries.py`` holds the thin
``opN_<name>`` queries and their SQL; each operator module keeps a general
interface of its own.
"""
