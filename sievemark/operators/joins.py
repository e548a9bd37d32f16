"""Joins that hold when one key has a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than one of so many shares of all rows; so there are fewer hot keys than this.
HOT_SHARES = 1000
#: Rows below which a key is never hot.
HOT_ROWS = 20_000


def hot_keys(df: DataFrame, keys: list[str], shares: int = HOT_SHARES, least: int = HOT_ROWS) -> DataFrame:
    """The keys with more than 1/``shares`` of the rows of ``df`` (and at least ``least``), with ``n_rows``.

    At most ``shares`` rows come out whatever the input, so the result may be broadcast. The count is
    combined on the map side; the total is a scalar subquery over the counts.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    total = counts.agg(F.sum("n_rows").alias("total"))
    limit = F.greatest(F.lit(float(least)), total.scalar() / F.lit(float(shares)))
    usable = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return counts.where(usable & (F.col("n_rows") > limit))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread: Column,
    how: str = "left",
    salts: int = 64,
    shares: int = HOT_SHARES,
    least: int = HOT_ROWS,
) -> DataFrame:
    """``left`` joined with ``right`` on ``keys``; ``right`` is unique on them or nearly so.

    Rows of hot keys are spread over ``salts`` partitions by the hash of ``spread`` (a column that
    differs within a key), and the few matching rows of ``right`` are repeated for each salt. All other
    keys have salt 0. Null keys match nothing and are spread as well. ``how`` is ``left`` or ``inner``.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"how must be left or inner, not {how}")
    hot = hot_keys(left, keys, shares, least).select(*keys, F.lit(True).alias("_hot"))
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    salt = F.when(F.col("_hot") | any_null, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    lhs = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    rhs = right.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return lhs.join(rhs, [*keys, "_salt"], how).drop("_salt")
