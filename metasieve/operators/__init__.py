"""Filters and validation as columns, and what they do to DataFrames."""
