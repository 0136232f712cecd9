"""Training-data operators: deduplication, classification, packing and storage formats.

Nothing else in the library imports this subpackage. Its queries are collected
in :mod:`tidewheel.llm.registry`.
"""
