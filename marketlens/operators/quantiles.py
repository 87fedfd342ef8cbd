"""Exact quantiles per group without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_BROADCAST_GROUPS = 1_000


def _below_sql(cut: str, low: int, high: int) -> str:
    """How many of the cuts ``low`` to ``high - 1`` lie below ``_v``, found by halving."""
    if low == high:
        return str(low)
    middle = (low + high) // 2
    return (
        f"CASE WHEN _v > get(_cuts, {cut.format(middle)}) "
        f"THEN {_below_sql(cut, middle + 1, high)} ELSE {_below_sql(cut, low, middle)} END"
    )


def exact_quantiles(
    weighted: DataFrame,
    group: str,
    value: str,
    weight: str,
    probabilities: Sequence[float],
    blocks: int = 16,
    groups_at_most: int | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles of ``value`` repeated ``weight`` times, per group.

    ``weighted`` has one row per distinct (group, value). A bounded sketch cuts the values of
    each group into ``blocks`` squared about even buckets. Bucket totals, at most that many
    rows per group, tell which buckets hold the wanted ranks, and only those are then
    sorted, each in a task of its own. The sketch places the cuts only; the result is exact.

    ``groups_at_most`` is a bound on the number of groups, where the caller has one; up to a
    thousand, the cuts and targets are broadcast, so that no group moves to one task to
    meet them. Without a bound Spark picks the join and splits skewed partitions.

    Returns ``group``, ``rows`` and ``quantiles`` (an array in the order asked for).
    """
    few = groups_at_most is not None and groups_at_most <= MAX_BROADCAST_GROUPS
    hint = F.broadcast if few else (lambda table: table)
    data = weighted.select(group, F.col(value).alias("_v"), F.col(weight).alias("_w"))
    # The weight takes part so that all uses of the input share one shuffle.
    cut_at = [i / blocks**2 for i in range(1, blocks**2)]
    cuts = data.groupBy(group).agg(
        F.percentile_approx(F.when(F.col("_w") > 0, F.col("_v")), cut_at, 10_000).alias("_cuts")
    )
    # First the block of buckets, then the bucket in it, keep the expression small.
    block = _below_sql(f"{{}} * {blocks} + {blocks - 1}", 0, blocks - 1)
    in_block = _below_sql(f"_block * {blocks} + {{}}", 0, blocks - 1)
    placed = (
        data.join(hint(cuts), group)
        .withColumn("_block", F.expr(block))
        .select(group, "_v", "_w", F.expr(f"_block * {blocks} + {in_block}").alias("_bucket"))
    )
    totals = placed.groupBy(group, "_bucket").agg(F.sum("_w").alias("_in_bucket"))
    by_bucket = Window.partitionBy(group).orderBy("_bucket")
    whole = Window.partitionBy(group)
    offsets = totals.select(
        group,
        "_bucket",
        "_in_bucket",
        (F.sum("_in_bucket").over(by_bucket) - F.col("_in_bucket")).alias("_before"),
        F.sum("_in_bucket").over(whole).alias("rows"),
    )
    # Zero-based positions whose values each quantile is interpolated between.
    position = [F.lit(float(p)) * (F.col("rows") - 1) for p in probabilities]
    wanted = F.array_distinct(
        F.array(*[F.floor(p).cast("bigint") for p in position],
                *[F.ceil(p).cast("bigint") for p in position])
    )
    inside = F.filter(
        wanted,
        lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_in_bucket")),
    )
    targets = offsets.withColumn("_ranks", inside).filter(F.size("_ranks") > 0)
    running = Window.partitionBy(group, "_bucket").orderBy("_v")
    at_rank = (
        placed.join(hint(targets), [group, "_bucket"])
        .withColumn("_end", F.sum("_w").over(running) + F.col("_before"))
        .select(
            group,
            "rows",
            "_v",
            F.explode(
                F.filter(
                    "_ranks",
                    lambda r: (r < F.col("_end")) & (r >= F.col("_end") - F.col("_w")),
                )
            ).alias("_rank"),
        )
    )
    # A handful of rows per group: one per wanted rank.
    found = at_rank.groupBy(group).agg(
        F.max("rows").alias("rows"),
        F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"),
    )
    quantiles = []
    for p in position:
        low = F.element_at("_at", F.floor(p).cast("bigint"))
        high = F.element_at("_at", F.ceil(p).cast("bigint"))
        quantiles.append(low + (high - low) * (p - F.floor(p)))
    return found.select(group, "rows", F.array(*quantiles).alias("quantiles"))
