"""Operators of a training-data pipeline over text, pages and embeddings.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds
its queries when it can be imported.
"""
