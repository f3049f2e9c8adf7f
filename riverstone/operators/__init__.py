"""Operators on DataFrames of points."""
