"""A Spark-native engine for document retrieval, privacy and corpus preparation."""
