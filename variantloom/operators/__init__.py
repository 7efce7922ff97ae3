"""The steps of association and meta-analysis, as functions from DataFrames to DataFrames."""
