"""Note-graph, retrieval and data-preparation operators written for Spark DataFrames."""
