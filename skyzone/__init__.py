"""A PySpark-native engine for matching catalogues of positions on the sphere."""

__version__ = "0.1.0"
