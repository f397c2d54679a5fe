"""Spark-native analytics over slot-numbered, versioned key-value logs and storage metadata."""
