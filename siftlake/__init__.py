"""Spark-native engine for document intelligence, record analytics and training-data preparation."""
