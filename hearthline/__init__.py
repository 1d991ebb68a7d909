"""hearthline: a PySpark-native analytics engine for housing notices and transactions."""

__version__ = "0.1.0"
