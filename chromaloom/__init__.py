"""Paint-by-numbers data jobs on Spark: DataFrames in, DataFrames out."""
