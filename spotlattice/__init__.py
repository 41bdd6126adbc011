"""Spark-native copy-number and clone analysis for sparse spatial DNA sequencing."""
