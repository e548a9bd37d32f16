"""The N best items of every group, also where one group has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins per doubling of ``1 + |score|``. The number of bins of a group has a fixed bound (2 x 1024 x this).
BINS_PER_OCTAVE = 256
#: A group is heavy if it has more than one of so many shares of all rows; so there are fewer heavy groups than this.
HEAVY_SHARES = 20_000
#: Rows below which a group is never heavy.
HEAVY_ROWS = 5_000


def score_bin(score: Column) -> Column:
    """A whole number that never falls as the score rises: the score's place on a signed logarithmic scale."""
    return (F.signum(score) * F.floor(F.log2(F.abs(score) + 1.0) * BINS_PER_OCTAVE)).cast("bigint")


def _rows(df: DataFrame, group: str, item: str, score: str) -> DataFrame:
    s = F.col(score).cast("double")
    full = (F.col(group) != "") & (F.col(item) != "") & s.isNotNull() & ~F.isnan(s)
    return df.where(full).select(F.col(group).alias("g"), F.col(item).alias("i"), (s + 0.0).alias("s"))


def group_thresholds(rows: DataFrame, n: int) -> DataFrame:
    """``(g, n_rows, least_bin)``: rows below ``least_bin`` can't be among the ``n`` best items of their group.

    The histogram of a group has, for each score bin, the number of rows and the least and greatest item.
    Going down from the top bin these items are gathered, without repeats; once there are ``n`` of them, at
    least ``n`` different items score in that bin or above, whatever was delivered twice. A group in which
    that never happens has a null ``least_bin``: all its rows stay.
    """
    bins = rows.groupBy("g", score_bin(F.col("s")).alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("i").alias("lo"), F.max("i").alias("hi"))
    downward = F.sort_array(F.collect_list(F.struct("b", "lo", "hi")), asc=False)
    groups = bins.groupBy("g").agg(F.sum("c").alias("n_rows"), downward.alias("h"))
    start = F.struct(F.array().cast("array<string>").alias("ids"), F.lit(None).cast("bigint").alias("b"))

    def step(acc: Column, x: Column) -> Column:
        ids = F.array_union(acc["ids"], F.array(x["lo"], x["hi"]))
        done = acc["b"].isNotNull()
        return F.struct(F.when(done, acc["ids"]).otherwise(ids).alias("ids"), F.when(done, acc["b"]).when(F.size(ids) >= n, x["b"]).alias("b"))

    return groups.select("g", "n_rows", F.aggregate("h", start, step)["b"].alias("least_bin"))


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, heavy_shares: int = HEAVY_SHARES, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """``(group, rnk, item)`` and ``score``: the ``n`` best items of each group, ``rnk`` from 1.

    Higher scores come first; of equal scores the smaller item (by code point). An item counts once per
    group, with its best score. Rows with a null or empty group or item, or a null or NaN score, do not
    count; infinite scores do, and -0.0 equals 0.0. Only the three named columns are read.

    1. A histogram per group, combined before the shuffle, gives each group a safe lower threshold.
    2. Heavy groups (fewer than ``heavy_shares``, by their share of all rows) get theirs by broadcast, so
       their rows are cut before any shuffle. What stays is made unique by (group, item), which spreads a
       group over all partitions, and ranked with a limit before and after the shuffle: ties of millions
       of rows at the threshold are never gathered in one task.
    3. All other groups are joined with their thresholds on the group, cut, and ranked where they lie.
    """
    rows = _rows(df, group, item, score)
    limits = group_thresholds(rows, n)
    total = limits.agg(F.sum("n_rows").alias("t"))
    heavy = F.col("n_rows") > F.greatest(F.lit(float(heavy_rows)), total.scalar() / F.lit(float(heavy_shares)))
    big = F.broadcast(limits.where(heavy).select("g", "least_bin"))
    stays = F.col("least_bin").isNull() | (score_bin(F.col("s")) >= F.col("least_bin"))
    best = Window.partitionBy("g").orderBy(F.desc("s"), F.asc("i"))

    def ranked(x: DataFrame) -> DataFrame:
        one = x.groupBy("g", "i").agg(F.max("s").alias("s"))
        return one.withColumn("rnk", F.row_number().over(best)).where(F.col("rnk") <= n)

    hot = ranked(rows.join(big, "g").where(stays))
    cold = ranked(rows.join(big, "g", "left_anti").join(limits.where(~heavy).select("g", "least_bin").hint("shuffle_merge"), "g").where(stays))
    return hot.unionByName(cold).select(F.col("g").alias(group), F.col("rnk").cast("bigint").alias("rnk"), F.col("i").alias(item), F.col("s").alias("score"))
