"""lodestead: a Spark-native engine for site retrieval and corpus processing."""
