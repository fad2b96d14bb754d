"""Operators on DataFrames: joins, rankings, aggregations."""
