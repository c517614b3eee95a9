"""A Spark-native engine for stylometric and forensic text analysis."""
