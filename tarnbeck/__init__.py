"""tarnbeck: a PySpark-native engine for document, rule and reference corpora."""

__version__ = "0.1.0"
