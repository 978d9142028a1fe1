"""Operators: DataFrame in, DataFrame out; all work is done by Spark expressions."""
