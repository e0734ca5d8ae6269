"""A PySpark-native engine for retrieval and analytics over a library of documents."""
