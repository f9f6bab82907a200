"""Registry of fixture-bound queries: name -> (Spark builder, DuckDB oracle SQL).

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole driver tables; sinks, streams and checkpoints run while it is built. Oracle SQL is an independent DuckDB statement over the
same tables; ``None`` marks queries that are not SQL-expressible (model fits,
hash shuffles), which get the driver's rows-only check.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}

_MODULES = ("q_lyrics", "q_pages", "q_dialogue", "q_labels", "q_sequences",
            "q_eval", "q_recommend", "q_sources", "q_streams")


def register(name: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    for mod in _MODULES:
        importlib.import_module(f"moodspark.plans.{mod}")


def queries() -> dict[str, Builder]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLE)
