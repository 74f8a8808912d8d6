"""Spark-native dependency mining, schema decomposition and corpus preparation."""
