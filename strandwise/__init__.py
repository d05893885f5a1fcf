"""Knowledge-graph constraint retrieval over DataFrames."""
