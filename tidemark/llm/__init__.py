"""Training-data operators: deduplication, tokenization, scans, packing, search and text classifiers.

Nothing else in the library imports this subpackage.
"""
