"""A PySpark-native code-map analytics engine."""
