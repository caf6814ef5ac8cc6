"""Table question-answering data jobs on Spark DataFrames."""
