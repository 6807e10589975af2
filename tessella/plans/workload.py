"""All registered queries: importing a module registers its queries."""

from tessella.plans import dataset_queries, graph_queries, study_queries, text_queries  # noqa: F401
from tessella.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
