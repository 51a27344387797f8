"""Evidara: retrieval and document analytics as declarative PySpark plans."""
