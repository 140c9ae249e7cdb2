"""Loads every query module and returns the catalogue."""

from __future__ import annotations

import importlib

from telemetra.plans.catalog import ENTRIES, Entry

MODULES = ("q_stats", "q_series", "q_formula", "q_names", "q_ingest", "q_folder", "q_lookup", "q_analyzers")


def entries() -> dict[str, Entry]:
    for name in MODULES:
        importlib.import_module(f"telemetra.plans.{name}")
    return ENTRIES
