"""A PySpark-native engine for metadata graphs."""
