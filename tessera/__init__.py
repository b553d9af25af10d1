"""Tessera: a PySpark-native engine for measuring style features in text corpora."""
