"""skerry: a Spark-native text retrieval, ranking and corpus-processing engine."""
