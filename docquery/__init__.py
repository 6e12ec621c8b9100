"""docquery: document collections processed as Spark DataFrames."""
