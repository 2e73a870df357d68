"""A semantic layer for Spark: views of dimensions and metrics, answered as lazy DataFrames."""
