"""Spark-native multi-field entity search and analytics."""
