"""Registered queries: one Spark callable per operator, most with an equivalent SQL text."""

from tripleloom.catalog import filters, joins, models, syntax, tables, training  # noqa: F401
from tripleloom.catalog.base import CASES

__all__ = ["CASES"]
