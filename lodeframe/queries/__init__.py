"""Registered queries: each binds an operator to the test tables and carries the SQL of the same result."""

from .registry import ORACLE, QUERIES
from . import holes, model, tables  # noqa: F401, E402  registers them

__all__ = ["ORACLE", "QUERIES"]
