"""Spark jobs that turn irregular count reports into complete, consistent series."""
