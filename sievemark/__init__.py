"""A Spark-native engine for rule-based record matching, auditing and corpus preparation."""

__version__ = "0.1.0"
