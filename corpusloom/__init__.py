"""Corpus analytics, retrieval and data preparation as lazy PySpark DataFrame operators."""
