"""Furrow: a Spark-native engine for knowledge-corpus analytics (see README)."""
