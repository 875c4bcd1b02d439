"""A PySpark-native analytics engine for point-in-time panel data."""
