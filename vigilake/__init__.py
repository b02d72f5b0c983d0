"""A PySpark-native drug-safety evidence engine."""

__version__ = "0.1.0"
