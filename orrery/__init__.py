"""orrery: a PySpark-native knowledge-retrieval and analytics engine."""
