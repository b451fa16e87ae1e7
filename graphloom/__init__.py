"""Knowledge-graph construction, retrieval and document processing on Spark DataFrames."""
