"""tessera: paired-evaluation and ablation analytics on Spark DataFrames."""
