"""Spark-native engine for taxonomy matching, decision tables and match evaluation."""
