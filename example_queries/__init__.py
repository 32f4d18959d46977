"""Queries on the example tables, one per operator, each with the same query as plain SQL."""

from example_queries import contracts, files, profiles, rules, samples  # noqa: F401
from example_queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
