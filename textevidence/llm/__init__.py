"""Operators for text corpora that feed language-model training.

Nothing outside this package imports it.  Every operator takes and returns DataFrames.
"""
