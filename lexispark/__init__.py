"""Question answering, fuzzy entity analytics and graph-pattern queries as Spark DataFrames."""
