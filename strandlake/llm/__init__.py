"""Operators for training-data pipelines: filters, de-duplication, scoring and packing of documents.

Nothing else in the package imports this subpackage.
"""
