"""Change-reachability analytics expressed as Spark DataFrames, SQL and streaming state."""
