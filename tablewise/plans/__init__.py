"""The registered queries and the SQL that checks them."""

from . import modeling, quality, statistics, timeseries  # noqa: F401  (registration)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
