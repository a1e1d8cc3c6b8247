"""A PySpark-native engine for curating text corpora."""
