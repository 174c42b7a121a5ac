"""weftline: Spark-native alignment of long timed word sequences with long reference texts."""

__version__ = "0.1.0"
