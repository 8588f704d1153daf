"""PySpark-native similarity scoring engine."""
