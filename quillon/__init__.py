"""quillon: Spark-native analytics for learning corpora, ratings and event streams."""
