"""All queries of the engine with their SQL."""

from __future__ import annotations

from sieveworks.plans import contexts, corpora, dedups, projects, scans, states, web  # noqa: F401  they register their queries
from sieveworks.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
