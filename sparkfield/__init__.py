"""PySpark-native engine for symbolic tensors, grid fields, equation systems and waves."""

__version__ = "0.1.0"
