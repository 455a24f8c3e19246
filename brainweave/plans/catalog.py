"""All reference-side queries, by name, with the DuckDB SQL each must agree with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

FLAGSHIP = "hybrid_search"
MODULES = ("searching", "indexing", "texts", "linking", "capturing", "states", "reviewing", "looking", "feeding", "governing")


def queries() -> dict[str, Callable]:
    return {k: v[0] for m in MODULES for k, v in importlib.import_module(f"brainweave.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {
        k: v[1]
        for m in MODULES
        for k, v in importlib.import_module(f"brainweave.plans.{m}").QUERIES.items()
        if v[1] is not None
    }
