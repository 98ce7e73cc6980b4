"""Operators of the merge: DataFrames in, a DataFrame out."""
