"""Spark-native verified-corpus and evaluation analytics."""
