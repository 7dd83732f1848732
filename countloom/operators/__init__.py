"""Operators on report tables and series: DataFrames in, DataFrames out."""
