"""A Spark-native engine for single-file pyramids of map tiles, and operators for training data."""
