"""Spark-native evidence retrieval and graph analytics."""
