"""Scriptorium: a Spark-native engine for building and auditing document datasets."""
