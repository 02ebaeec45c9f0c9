"""Registered queries and their oracle SQL."""
from __future__ import annotations

from . import facts, library, patterns, raw, space, stats, tactical, timeline  # noqa: F401
from .registry import ORACLES, QUERIES, forget_layers

__all__ = ["ORACLES", "QUERIES", "forget_layers"]
