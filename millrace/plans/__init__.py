"""Registered queries, by area."""

from __future__ import annotations

import importlib

from millrace.plans.registry import ORACLES, QUERIES

AREAS = (
    "relational",
    "joining",
    "aggregating",
    "functions",
    "timed",
    "streams",
    "patterns",
    "graphs",
    "learning",
    "applications",
    "storage",
)


def load_all():
    """Import every area and return (queries, oracles)."""
    for area in AREAS:
        importlib.import_module(f"millrace.plans.{area}")
    return QUERIES, ORACLES
