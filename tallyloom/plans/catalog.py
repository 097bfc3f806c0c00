"""All registered queries: name to (function, SQL or None)."""

from __future__ import annotations

from importlib import import_module

PARTS = ["ledger", "rules", "entities", "events", "cases", "matching", "state", "sources"]


def all_queries() -> dict:
    out: dict = {}
    for part in PARTS:
        found = import_module(f"tallyloom.plans.catalog_{part}").Q
        twice = out.keys() & found.keys()
        if twice:
            raise ValueError(f"registered twice: {twice}")
        out |= found
    return out
