"""Scalar and aggregate functions by dialect: ``call(dialect, name, *columns)`` gives a Column.

Names whose semantics equal a Spark built-in are that built-in; the others are composed of built-ins and
stay inside Catalyst; the few that no built-in can express are Arrow-batched pandas UDFs (``numeric``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.flink import FLINK
from tessera.functions.presto import PRESTO
from tessera.functions.spark import SPARK

DIALECTS: dict[str, dict[str, Callable[..., Column]]] = {"spark": SPARK, "presto": PRESTO, "flink": FLINK}


def names(dialect: str) -> list[str]:
    return sorted(DIALECTS[dialect])


def call(dialect: str, name: str, *args) -> Column:
    """The function ``name`` of a dialect over columns; other arguments than columns and lambdas become literals."""
    functions = DIALECTS[dialect]
    if name not in functions:
        raise KeyError(f"{dialect} has no function {name}")
    return functions[name](*(a if isinstance(a, Column) or callable(a) else F.lit(a) for a in args))
