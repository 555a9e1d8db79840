"""Larkspur: a multi-model analytics engine on plain Spark DataFrames."""
