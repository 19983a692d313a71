"""Spark-native retrieval analytics over tabular records with text fields."""
