"""Operators for preparing large text corpora for model training.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames; its docstring states what it does with nulls, empty texts, ties,
repeated rows and empty tables.
"""
