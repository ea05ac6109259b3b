"""All registered queries of the library."""

from quantloom.plans import q_bars, q_market, q_research  # noqa: F401
from quantloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
