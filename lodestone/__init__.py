"""Spark-native retrieval and analytics over source corpora and activity ledgers."""
