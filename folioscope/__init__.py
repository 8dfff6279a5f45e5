"""A document retrieval and citation-graph engine on Spark DataFrames."""
