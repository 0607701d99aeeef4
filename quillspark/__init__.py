"""Quillspark: a document-corpus analytics engine of PySpark DataFrame operators."""
