"""Entity change history and data operators on Spark DataFrames."""
