"""Operators for training data of language models, and their queries."""

from tessella.llm import queries  # noqa: F401  registers the queries
from tessella.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
