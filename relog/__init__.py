"""A change-log replay and query engine on Spark DataFrames."""
