"""Operators for large training-data pipelines, on documents, pages and vectors."""
