"""A Spark-native engine that finds personal data in text, replaces it and verifies the result."""
