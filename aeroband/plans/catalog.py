"""Loads every module that registers queries."""

from __future__ import annotations

import importlib

MODULES = ["relational", "analytics", "sequences", "places", "messages", "alerting", "upkeep", "spectrum", "learning", "storage", "streams", "extending"]


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"aeroband.plans.{name}")
