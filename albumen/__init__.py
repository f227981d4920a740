"""A PySpark-native analytics engine for media libraries."""
