"""Operators for large training-data corpora. Nothing else in keyweave imports this subpackage."""
