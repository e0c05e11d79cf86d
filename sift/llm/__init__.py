"""Operators for preparing training data at scale (documents, embeddings).

Nothing outside this folder imports it; ``__spark_entry__.py`` registers its
queries (``queries.py``) only when the folder is present.
"""
