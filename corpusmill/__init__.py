"""A Spark-native corpus engine: sources, text functions, search, conversation analytics."""
