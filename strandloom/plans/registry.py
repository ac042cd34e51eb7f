"""All queries of the engine by name, and their SQL."""

from strandloom.plans.oracle import SQL
from strandloom.plans.queries import QUERIES

__all__ = ["QUERIES", "SQL"]
