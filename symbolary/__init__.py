"""A PySpark-native code and text analytics engine."""
