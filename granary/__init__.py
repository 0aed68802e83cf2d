"""granary: a PySpark-native engine for knowledge retrieval and document analytics."""

__version__ = "0.1.0"
