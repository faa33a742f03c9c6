"""A Spark-native engine for recursive, equality-aware queries and large-scale data preparation."""
