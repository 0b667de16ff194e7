"""The operators, as functions of DataFrames and Columns."""
