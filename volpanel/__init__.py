"""PySpark-native analytics over daily option-quote panels."""

__version__ = "0.1.0"
