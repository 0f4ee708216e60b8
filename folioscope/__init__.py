"""A Spark-native engine for auditing document-derived evidence and preparing text corpora."""
