"""The registered queries, each a plan over the given tables, with its SQL twin where SQL can express it."""

from . import clean_queries, evidence_queries, forecast_queries, review_queries, stock_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
