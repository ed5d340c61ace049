"""Operators for preparing language-model training data; nothing else in the library imports this package."""

from __future__ import annotations

import importlib

_MODULES = ("decontaminate", "url_filters", "packing", "repeats", "toxicity", "near_dedup", "secrets", "sharding", "exact_dedup", "token_counts")


def _loaded():
    return [importlib.import_module(f"{__name__}.{m}") for m in _MODULES]


def queries() -> dict:
    return {m.NAME: m.query for m in _loaded()}


def oracle_sql() -> dict:
    return {m.NAME: m.SQL for m in _loaded() if m.SQL}
