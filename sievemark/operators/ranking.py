"""Ranking within groups: top k, quotas, display order, running budgets, default rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rnk") -> DataFrame:
    """The first ``k`` rows of each group in ``order`` (which should be total), numbered from 1.

    The limit is applied before and after the shuffle by the engine's group limit.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """All rows, numbered from 1 within their group in ``order`` (which should be total)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def place_listed(df: DataFrame, listed: DataFrame, group: str, item: str, name: str = "place") -> DataFrame:
    """Adds the place (from 0, by item) of ``item`` among the distinct items that ``listed`` has for the group; null if it isn't there.
    The list is ranked once and joined by group and item, so a group with many rows is not searched by each of them."""
    once = listed.select(group, item).distinct()
    ranked = once.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(item)) - 1)
    return df.join(ranked, [group, item], "left")


def accept(df: DataFrame, group: list[str], order: list[Column], passes: Column, quota: Column) -> DataFrame:
    """Adds ``accepted``: true for rows that pass while fewer than ``quota`` before them in the group passed."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ok = F.coalesce(passes, F.lit(False))
    return df.withColumn("accepted", ok & (F.sum(ok.cast("int")).over(w) <= quota))


def with_defaults(df: DataFrame, keys: DataFrame, key: str, **values: Column) -> DataFrame:
    """``df`` and, for each key of ``keys`` without a row, one row with ``values`` (all else null)."""
    both = df.withColumn("_there", F.lit(True)).join(keys.select(key).distinct(), key, "full")  # one pass over ``df``
    filled = {c: F.when(F.col("_there").isNull(), v).otherwise(F.col(c)) for c, v in values.items()}
    return both.withColumns(filled).select(df.columns)


def running_budget(df: DataFrame, group: list[str], order: list[Column], amount: Column, budget: int) -> DataFrame:
    """The rows of each group, in order, while the sum of ``amount`` stays within ``budget``."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_used", F.sum(amount).over(w)).where(F.col("_used") <= budget).drop("_used")


def place_in(item: Column, order: Column, beyond: int = 950) -> Column:
    """The place of ``item`` in the array ``order`` from 0, or ``beyond`` if it isn't there."""
    at = F.coalesce(F.array_position(order, item), F.lit(0))
    return F.when(at > 0, at - 1).otherwise(beyond).cast("int")
