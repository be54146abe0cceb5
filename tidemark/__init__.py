"""Tidemark: versioned key-value change logs as DataFrames, on PySpark."""
