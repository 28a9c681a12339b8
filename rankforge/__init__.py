"""Retrieval and evaluation on DataFrames."""
