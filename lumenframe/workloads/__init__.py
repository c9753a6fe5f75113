"""The registered queries, grouped by topic."""

from . import charting, correlating, describing, finding, messaging, ranking, sampling, sourcing, trending
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "charting", "correlating", "describing", "finding", "messaging", "ranking",
           "sampling", "sourcing", "trending"]
