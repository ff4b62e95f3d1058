"""Text retrieval and citation-graph analytics on Spark DataFrames."""
