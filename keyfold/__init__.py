"""keyfold: keyed-fold analytics on Spark DataFrames."""
