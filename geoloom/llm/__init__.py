"""Training-data operators: ten components for corpus preparation and one pipeline.

Nothing outside this subpackage imports it.  Each module documents the result it
defines for nulls, empty and very long texts, ties, repeated rows, empty tables
and extra columns.
"""
