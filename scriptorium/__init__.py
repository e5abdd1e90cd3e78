"""A Spark-native engine for indexing, searching and refining document collections."""
