"""Plumbline: a PySpark-native engine for project documents, retrieval and construction schedules."""
