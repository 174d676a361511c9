"""doclens: document conversion, verification and corpus operators on Spark DataFrames."""
