"""glyphmill: Spark-native analytics over labelled, sparse, token-valued tables."""
