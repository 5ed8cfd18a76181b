"""A PySpark-native analytics engine for cross-marketplace product data."""
