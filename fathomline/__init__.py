"""A PySpark-native engine for searching, ranking, expanding, clustering and evaluating document collections."""
