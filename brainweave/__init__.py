"""brainweave: a Spark-native analytics library for personal-knowledge data."""
