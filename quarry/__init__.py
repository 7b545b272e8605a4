"""Spark-native document retrieval and conversation analytics."""
