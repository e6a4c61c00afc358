"""Operators for training-data pipelines over the tables of documents, pages, vectors and labels.

Nothing else in the library imports this package.
"""
