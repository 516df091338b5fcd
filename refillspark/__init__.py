"""A PySpark-native analytics engine for longitudinal event data."""
