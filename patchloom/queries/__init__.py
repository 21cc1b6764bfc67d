"""Queries over the test tables with their SQL, by subject."""

from __future__ import annotations

import importlib

SUBJECTS = ("statistics", "imaging", "features", "learning", "files", "relational", "compaction")


def _all(name: str) -> dict:
    out: dict = {}
    for subject in SUBJECTS:
        out |= getattr(importlib.import_module(f"patchloom.queries.{subject}"), name)
    return out


def all_queries() -> dict:
    return _all("QUERIES")


def all_oracles() -> dict[str, str]:
    return _all("ORACLES")
