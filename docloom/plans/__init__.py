"""Registered queries and their SQL."""

from docloom.plans import relational, sequences, texts  # noqa: F401
from docloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
