"""Spark-native fraud analytics and feature engineering operators."""
