"""A PySpark-native engine for versioned document corpora."""

__version__ = "0.1.0"
