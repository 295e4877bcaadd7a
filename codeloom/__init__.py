"""Spark-native analysis of code changes: parsing, linking, context selection, comment triage and storage."""
