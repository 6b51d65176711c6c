"""Registered queries with their reference SQL, one module per part of the inventory."""

from __future__ import annotations

from . import flows, forecasts, indicators, ledgers, panels, rotations, selections, sources  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
