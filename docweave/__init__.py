"""A PySpark-native engine for structured document collections."""
