"""Registered queries (one per operator of the coverage list) and presets."""

from . import q_conv, q_corpus, q_retrieval, q_stream, q_text  # noqa: F401  (registers queries)
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
