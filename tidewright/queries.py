"""All registered queries: importing this module registers them."""

from __future__ import annotations

from tidewright.plans import change_queries, snapshot_queries  # noqa: F401
from tidewright.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
