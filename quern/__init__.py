"""Quern: retrieval, curation and corpus analytics as PySpark DataFrame transformations."""
