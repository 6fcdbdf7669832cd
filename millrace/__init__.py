"""A PySpark-native engine for enriching and curating web corpora."""
