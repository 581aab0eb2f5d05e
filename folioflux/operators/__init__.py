"""Functions from DataFrames to DataFrames; none of them runs an action."""
