"""Embedding-similarity search over sequence corpora, as PySpark DataFrame operators."""

__version__ = "0.1.0"
