"""Joins and ordered sums that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode(df: DataFrame, keep: Sequence, items: Column | str, item: str, place: str | None = None) -> DataFrame:
    """One row per array entry, with its place from 0 if asked for. Entries are never null.

    A plain explode makes the optimizer test the array's size below the projection that builds it,
    which builds it twice; the outer form with a filter above builds it once.
    """
    if place:
        rows = df.select(*keep, F.posexplode_outer(items).alias(place, item))
    else:
        rows = df.select(*keep, F.explode_outer(items).alias(item))
    return rows.where(F.col(item).isNotNull())


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that keeps the left keys and lets null keys meet each other."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    joined = left.join(renamed, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{k}" for k in keys])


def running_totals(
    df: DataFrame,
    group: str,
    order: str,
    totals: dict[str, str],
    block_bits: int = 20,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Add, per group, the sum of each value over all rows that come earlier.

    A single window per group would put a hot group on one task. Here rows are windowed within
    blocks of ``2**block_bits`` order values, and only the block sums are windowed per group.
    ``totals`` maps the new column to the summed one. All columns of ``df`` pass through the window, so
    rows are never joined back: null orders come last, rows of equal order follow each other by the
    columns ``ties``, and each row comes out once.
    """
    # A null group is a group; the two stand-in columns let all steps share one partitioning.
    keys = ["__key", "__key_null", "__block"]
    marked = df.select(
        "*",
        F.coalesce(F.col(group).cast("string"), F.lit("")).alias("__key"),
        F.col(group).isNull().alias("__key_null"),
        # Above every block of a known order, so that rows without one come last.
        F.coalesce(F.shiftright(F.col(order).cast("bigint"), block_bits), F.lit(2**62)).alias("__block"),
    )
    within = [F.col(order).asc_nulls_last(), *ties]
    earlier_rows = Window.partitionBy(*keys).orderBy(*within).rowsBetween(Window.unboundedPreceding, -1)
    earlier_blocks = Window.partitionBy(*keys[:2]).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    per_block = marked.groupBy(*keys).agg(
        *[F.sum(F.col(value).cast("bigint")).alias(f"__b_{new}") for new, value in totals.items()]
    )
    starts = per_block.select(
        *keys,
        *[F.coalesce(F.sum(f"__b_{new}").over(earlier_blocks), F.lit(0)).alias(f"__s_{new}") for new in totals],
    )
    inner = marked.select(
        "*",
        *[
            F.coalesce(F.sum(F.col(value).cast("bigint")).over(earlier_rows), F.lit(0)).alias(f"__i_{new}")
            for new, value in totals.items()
        ],
    )
    return inner.join(starts, keys).select(
        *df.columns, *[(F.col(f"__i_{new}") + F.col(f"__s_{new}")).alias(new) for new in totals]
    )


def first_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per group, numbered from 1.

    The filter on ``row_number`` lets Spark cut every task's share to ``k`` rows per group before
    the shuffle, so a hot group moves at most ``k`` rows per task.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    numbered = df.withColumn(rank, F.row_number().over(window))
    return numbered.where(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("bigint"))
