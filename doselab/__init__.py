"""A PySpark-native engine for controlled-exposure text corpora."""
