"""Registered queries and their DuckDB counterparts, module by module."""

from __future__ import annotations

import importlib

MODULES = ("data", "places", "search", "transit", "usage", "streams", "composed", "journeys")


def collect(attribute: str) -> dict:
    """All entries of `QUERIES` or `ORACLES` of the modules."""
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"geoloom.plans.{name}"), attribute)
    return out
