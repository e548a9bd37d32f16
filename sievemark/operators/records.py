"""Records that are delivered more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sorts after every real time: a delivery without a time is never the first one.
_NEVER = "9999-12-31 00:00:00"


def first_delivery(df: DataFrame, key: str, time: str, *columns: str) -> DataFrame:
    """One row per ``key``: ``columns`` and ``time`` of its delivery with the least ``time``.

    Rows whose key is null are no records and are left out. Of equal times the least values win, so
    the result does not depend on partitioning; a delivery whose time is null comes last. The rows
    are combined before the shuffle.
    """
    kind = dict(df.dtypes)[time]
    order = F.coalesce(F.col(time), F.lit(_NEVER).cast(kind))
    best = F.min(F.struct(order.alias("_at"), *[F.col(c) for c in (time, *columns)]))
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("_first"))
    return out.select(key, *[F.col("_first")[c].alias(c) for c in (time, *columns)])


def present(column: Column) -> Column:
    """True where a key is neither null nor the empty string."""
    return column.isNotNull() & (column != "")
