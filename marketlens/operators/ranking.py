"""Counts and top-k lists that hold up when one key has a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(table: DataFrame, *keys: str) -> DataFrame:
    """Rows per key as ``n``. Each task counts its own rows first, so a hot key is cheap."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def top_counts(table: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` most frequent values of ``key``; ties go to the smaller key.

    Nulls are not counted. Sort and limit become one top-k step that keeps ``k`` rows
    per task.
    """
    counted = counts(table.filter(F.col(key).isNotNull()), key)
    return counted.orderBy(F.desc("n"), F.asc(key)).limit(k)


def one_per_element(
    table: DataFrame, elements: str | Column, name: str, *keep: str | Column
) -> DataFrame:
    """One row per array element that is not null, with the kept columns.

    A plain ``explode`` of a computed column makes Spark test the array for rows first,
    which computes it again; the outer form with a test of the element does not.
    """
    values = F.col(elements) if isinstance(elements, str) else elements
    rows = table.select(*keep, F.explode_outer(values).alias(name))
    return rows.filter(F.col(name).isNotNull())


def count_elements(table: DataFrame, elements: str | Column, name: str, *keys: str) -> DataFrame:
    """Occurrences of each array element as ``n``, per ``keys``; nulls are not counted."""
    return counts(one_per_element(table, elements, name, *keys), *keys, name)


def top_elements(
    table: DataFrame, elements: str | Column, name: str, k: int
) -> DataFrame:
    """The ``k`` most frequent array elements; ties go to the smaller one."""
    counted = count_elements(table, elements, name)
    return counted.orderBy(F.desc("n"), F.asc(name)).limit(k)


def with_share(counted: DataFrame, total: DataFrame, n: str = "n") -> DataFrame:
    """Add ``share`` = ``n`` / the single value of ``total``, 0 for an empty total."""
    whole = total.scalar().cast("double")
    return counted.withColumn(
        "share", F.coalesce(F.try_divide(F.col(n).cast("double"), whole), F.lit(0.0))
    )


def first_row(table: DataFrame, columns: Sequence[str]) -> Column:
    """A one-row table as a struct column for use in another query.

    Spark runs it once as a scalar subquery and hands the value to every task, so there
    is no join.
    """
    return table.select(F.struct(*columns)).scalar()
