"""Queries by name, and their DuckDB SQL."""

from foliospark.plans.oracle import SQL
from foliospark.plans.queries import QUERIES

__all__ = ["QUERIES", "SQL"]
