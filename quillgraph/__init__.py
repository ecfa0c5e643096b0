"""Property-graph, RDF, vector and scoring analytics on Spark DataFrames."""
