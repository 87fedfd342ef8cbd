"""Name an intermediate value inside one Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once per row.

    A Column that is used several times below a condition is computed anew at each use,
    and nesting multiplies that. A lambda variable over an array of one is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_sql(value: Column, sql_lambda: str) -> Column:
    """Like ``let`` with a SQL lambda such as ``t -> upper(t)``.

    SQL text reaches the JVM in one call, which long chains of Column calls do not.
    """
    applied = F.call_function("transform", F.array(value), F.expr(sql_lambda))
    return F.get(applied, F.lit(0))


def quoted(text: str) -> str:
    """``text`` as a SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
