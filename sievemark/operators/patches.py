"""Changes to relations: overrides, keyed updates, delete and insert, upserts, merges of two keyed sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def override(df: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``columns`` of ``df`` replaced by those of ``changes`` where there is a row for the keys and its value isn't null.

    ``changes`` has one row per key; its other columns are ignored.
    """
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    both = df.join(new, keys, "left")
    return both.withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns}).select(*df.columns)


def replace_group(df: DataFrame, rows: DataFrame, group: list[str]) -> DataFrame:
    """``df`` without the rows of the groups in ``rows``, and with ``rows``."""
    return df.join(rows.select(*group).distinct(), group, "left_anti").select(*df.columns).unionByName(rows.select(*df.columns))


def upsert(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``rows`` inserted, each in place of the row with its keys."""
    return replace_group(df, rows, keys)


def merge_sides(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All keys of either side, with ``in_left`` and ``in_right``; the sides' other columns must differ in name."""
    out = left.withColumn("in_left", F.lit(True)).join(right.withColumn("in_right", F.lit(True)), keys, "full")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("in_left", "in_right")})
