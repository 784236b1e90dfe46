"""Training-data operators for text corpora at large scale.

Each module holds one operator and states its results for nulls, empty and
long texts, ties, repeated rows, empty tables and extra columns. Nothing else
in the library imports this subpackage.
"""
