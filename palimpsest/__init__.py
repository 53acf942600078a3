"""Reversible masking of sensitive text, and training-data preparation, on Spark DataFrames."""
