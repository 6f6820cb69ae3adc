"""A PySpark-native engine for vector geospatial data."""
