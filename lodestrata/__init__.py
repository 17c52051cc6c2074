"""lodestrata: a Spark-first engine for document-derived knowledge graphs."""

__version__ = "0.1.0"
