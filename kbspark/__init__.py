"""A PySpark-native analytics engine for document knowledge bases."""
