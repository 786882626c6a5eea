"""Operators of a training-data pipeline: ten methods over documents, pages and embeddings. Nothing else in the library imports this package."""
