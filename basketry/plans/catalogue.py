"""Importing this module registers every query."""

from basketry.plans import (  # noqa: F401
    register_analysis,
    register_cleaning,
    register_customers,
    register_grading,
    register_metrics,
    register_parity,
    register_questions,
    register_retrieval,
    register_serving,
    register_warehouse,
)
from basketry.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
