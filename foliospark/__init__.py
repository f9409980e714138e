"""Foliospark: document-corpus analytics as Spark DataFrame plans."""
