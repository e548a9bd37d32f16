"""Ordered rows: fill down, segments by marker rows, first occurrences, next rows, ranges, dense rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.session import durable


def fill_down(df: DataFrame, group: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Blank or null cells take the last filled value above them in the group; cells above the first stay empty ("")."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.coalesce(F.last(F.nullif(F.trim(F.col(c)), F.lit("")), ignorenulls=True).over(w), F.lit("")) for c in columns}
    return df.withColumns(filled)


def segments(df: DataFrame, group: list[str], order: list[Column], marker: Column, name: str = "segment") -> DataFrame:
    """Adds the number of the segment each row belongs to; a marker row begins one. Rows before the first have 0."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.coalesce(marker, F.lit(False)).cast("int")).over(w).cast("int"))


def first_occurrence(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def following(df: DataFrame, group: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Adds ``next_<column>``: the value in the next row of the group, null in the last."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})


def in_ranges(df: DataFrame, point: str, ranges: DataFrame, low: str, high: str, keys: list[str], order: list[str], width: int) -> DataFrame:
    """``df`` with the first range (by ``order``) of its ``keys`` that holds ``point`` (both ends count); null without one.

    The distinct points of ``df`` and the ranges, cut to bins of ``width``, are joined on key and bin, so that
    no pair of a point and a range far from it is ever formed. Columns of ``ranges`` must not be in ``df``.
    """
    bins = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    points = df.where(F.col(point).isNotNull()).select(*keys, point).distinct().withColumn("_bin", F.floor(F.col(point) / width))
    extra = [c for c in ranges.columns if c not in keys]
    hit = points.join(bins, [*keys, "_bin"]).where(F.col(point).between(F.col(low), F.col(high)))
    first = hit.groupBy(*keys, point).agg(F.min(F.struct(*order, *[c for c in extra if c not in order])).alias("_r"))
    return df.join(first, [*keys, point], "left").select(*df.columns, *[F.col("_r")[c].alias(c) for c in extra])


def dense_rows(df: DataFrame, group: str, number: str, low: int = 1) -> DataFrame:
    """Every number from ``low`` to the group's greatest one, with the row of that number or nulls."""
    spans = df.groupBy(group).agg(F.max(number).alias("_top"))
    every = spans.where(F.col("_top") >= low).select(group, F.explode(F.sequence(F.lit(low), F.col("_top").cast("int"))).alias(number))
    return every.join(df.withColumn(number, F.col(number).cast("int")), [group, number], "left")


def batches(df: DataFrame, order: list[Column], size: int, group: list[str] | None = None) -> DataFrame:
    """Adds ``batch`` (from 0) and ``place`` (from 1) of rows in batches of ``size`` within each group.

    See ``numbered_wide`` for how.
    """
    at = numbered_wide(df, group or [], order, "_n")
    return at.withColumns({"batch": F.floor((F.col("_n") - 1) / size).cast("int"), "place": ((F.col("_n") - 1) % size + 1).cast("int")}).drop("_n")


def numbered_wide(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """All rows, numbered from 1 within their group (or over all of the input) in ``order``, which should be total.

    Rows are range-partitioned by group and order (and written once to the shared folder), numbered within their
    partition, and moved on by what the group has in earlier partitions. Only groups that lie in several partitions are
    moved, and there are fewer of these than partitions. So a group with a third of all rows is never gathered in one task.
    """
    parts = durable(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    local = parts.withColumn("_local", F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order)))
    keys = {f"_g{i}": F.col(g) for i, g in enumerate(group)}
    counts = parts.groupBy("_part", *[c.alias(n) for n, c in keys.items()]).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = counts.withColumn("_before", F.sum("_c").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).where(F.col("_before").isNotNull())
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(n)) for n, g in zip(keys, group, strict=True)], F.col("_part") == F.col("_p"))
    at = local.join(F.broadcast(before.withColumnRenamed("_part", "_p").select("_p", *keys, "_before")), same, "left")
    return at.withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_local")).drop("_local", "_part", "_p", "_before", *keys)
