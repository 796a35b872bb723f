"""Archive-integrity analytics expressed as Spark DataFrames."""
