"""A PySpark-native engine for searching and evaluating large collections of documents."""
