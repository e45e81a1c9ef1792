"""Spark-native retrieval analytics: DataFrame in, DataFrame out."""
