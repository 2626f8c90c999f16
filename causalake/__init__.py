"""causalake: causal target analytics on Spark DataFrames."""
