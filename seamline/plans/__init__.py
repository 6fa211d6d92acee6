"""Queries over the stand-in tables, each with DuckDB SQL where SQL can state it."""

from __future__ import annotations

import os
from collections.abc import Callable
from importlib import import_module

MODULES = ("series", "relational", "spatial", "density", "grids", "filters", "learning", "models", "signal", "depth")


def _registered() -> dict[str, tuple[Callable, str | None]]:
    return {name: entry for m in MODULES for name, entry in import_module(f"{__name__}.{m}").QUERIES.items()}


def _shipped(call: Callable) -> Callable:
    """Let Python workers import this package when it is run from a checkout."""

    def run(spark, sf_dir):
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        env = spark.sparkContext.environment
        known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
        if root not in known.split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
        return call(spark, sf_dir)

    return run


def queries() -> dict[str, Callable]:
    return {name: _shipped(call) for name, (call, _) in _registered().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _registered().items() if sql}
