"""Part of the Spark-native curation and retrieval engine."""
