"""A Spark-native hybrid retrieval engine over collections of files."""
