"""graphweave: build and curate knowledge graphs at scale with Spark DataFrames."""
