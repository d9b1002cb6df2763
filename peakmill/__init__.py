"""Spark-native enrichment analytics over sequencing reads."""
