"""lacuna: a PySpark engine for sparse entity x evaluation tables and the data work around them."""

__version__ = "0.1.0"
