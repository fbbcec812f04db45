"""loomframe: document-transformation operators expressed as Spark DataFrames."""
