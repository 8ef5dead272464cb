"""An analytics engine for very large collections of small files packed into shards, on Spark DataFrames."""
