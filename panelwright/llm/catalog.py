"""Registered queries of this subpackage."""

from __future__ import annotations

from . import (  # noqa: F401
    chat_windows, exact_dedup, license_scan, line_dedup, lm_scoring, merge_dropout, packing, prefix_trie, quality_rules, secret_scan,
    sharding, simhash_join, whitening,
)
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
