"""Lodestone: a PySpark-native engine for auditable evidence analytics."""
