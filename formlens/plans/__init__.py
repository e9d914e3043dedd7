"""Registered queries of the engine and the SQL they are compared with."""

from formlens.plans import analytics, anchors, layout, ledger  # noqa: F401
from formlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
