"""trovelens: a hybrid retrieval and corpus engine expressed as Spark DataFrames."""
