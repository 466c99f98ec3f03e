"""quillmark: document evidence scoring and record auditing on Spark DataFrames."""
