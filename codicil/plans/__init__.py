"""Registered queries; importing this package fills the registry."""

from codicil.plans import retrieval_queries  # noqa: F401
from codicil.plans import corpus_queries  # noqa: F401
from codicil.plans import grounding_queries  # noqa: F401
from codicil.plans import operations_queries  # noqa: F401
from codicil.plans.registry import PLANS, SQL

__all__ = ["PLANS", "SQL"]
