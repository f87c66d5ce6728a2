"""Training-data operators: deduplication, filtering, language, privacy, media and packing.

Nothing else in the library imports this package; its queries are in ``queries.py``.
"""
