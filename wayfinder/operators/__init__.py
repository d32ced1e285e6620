"""Plans as DataFrames, and changes to stored tables."""
