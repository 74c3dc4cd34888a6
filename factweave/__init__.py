"""Evidence analytics over Spark DataFrames: facts, graph, search, conflicts, quality and logs."""
