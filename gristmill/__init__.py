"""gristmill: a listings analytics engine written as PySpark DataFrame programs."""

__version__ = "0.1.0"
