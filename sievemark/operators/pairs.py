"""Pairs of rows that share tags, and their scores.

Pairs are never enumerated: both sides are exploded to (family, tag) and joined on equality, and the
shared tags are counted per pair. Tags that the left side has in a large share of its rows are spread over salts. How many
pairs share a tag is given by the data.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.text import TAG_JOIN
from sievemark.operators.joins import HOT_SHARES, salted_join
from sievemark.operators.ranking import top_k
from sievemark.session import durable

#: Names that are broadcast at once, and the characters of a name by which it is looked up.
BLOCK, HEAD = 100_000, 4
#: Tags of a family that have a bit of their own; the rest are compared as strings, where a bit of their hashes is shared.
BITS = 62
#: Pairs that one task forms of one key; keys that form more are cut into a grid.
CELL = 1 << 24


def tag_rows(df: DataFrame, key: str, sets: dict[str, Column]) -> DataFrame:
    """``(key, family, tag)``: one row per distinct tag of each family (arrays of strings) of each row."""
    kinds = F.array(*[F.struct(F.lit(n).alias("family"), c.alias("tags")) for n, c in sets.items()])
    rows = df.select(key, F.explode(kinds).alias("f"))
    return rows.select(key, F.col("f.family").alias("family"), F.explode(F.array_distinct("f.tags")).alias("tag")).where(F.col("tag").isNotNull() & (F.col("tag") != ""))


def shared_counts(left: DataFrame, right: DataFrame, left_key: str, right_key: str, families: list[str]) -> DataFrame:
    """``(left_key, right_key, n_<family>...)`` for every pair that shares a tag of any family, with the counts.

    ``left`` and ``right`` come from ``tag_rows``. The counts are combined on the map side of the one shuffle
    by pair that follows the join.
    """
    met = salted_join(left, right, ["family", "tag"], spread=F.col(left_key), how="inner")
    counts = [F.count_if(F.col("family") == f).cast("int").alias(f"n_{f}") for f in families]
    return met.groupBy(left_key, right_key).agg(*counts)


def _listed(names: list[str]) -> Column:
    """The names as one literal. They have no enumeration comma, as that parts the tags of a cell."""
    return F.split(F.lit(TAG_JOIN.join(names)), TAG_JOIN)


def bits_of(tags: Column, names: list[str]) -> Column:
    """The tags that are among ``names`` (62 at most) as bits, by their place there."""
    known = _listed(names)
    at = lambda t: F.array_position(known, t).cast("int")
    one = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n)
    none = F.lit(0).cast("bigint")
    return F.aggregate(tags, none, lambda a, t: F.when(at(t) > 0, a.bitwiseOR(one(at(t) - 1))).otherwise(a)) if names else none


def pack_sets(left: DataFrame, right: DataFrame, families: list[str]) -> tuple[DataFrame, DataFrame, dict[str, list[str]]]:
    """Both sides with each set of ``families`` (arrays of distinct strings) as ``<family>_hot``, bits of the tags that form most pairs,
    ``<family>_cold``, the other tags, and ``<family>_mask``, bits by the hashes of these: no bit in common, no tag in common.
    Third, the tags that have a bit."""
    rows = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("family"), F.col(n).alias("t")) for n in families])).alias("f")).select("f.family", F.explode("f.t").alias("tag"))
    count = lambda df, n: rows(df).groupBy("family", "tag").agg(F.count(F.lit(1)).alias(n))
    work = count(left, "nl").join(count(right, "nr"), ["family", "tag"]).withColumn("work", F.col("nl") * F.col("nr"))
    hot: dict[str, list[str]] = {n: [] for n in families}
    for r in top_k(work, ["family"], [F.desc("work"), F.asc("tag")], BITS).collect():  # BITS rows of each family at most
        hot[r["family"]].append(r["tag"])

    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(t), F.lit(64)).cast("int"))

    def packed(n: str) -> list[Column]:
        cold = F.filter(n, lambda t: ~F.array_contains(_listed(hot[n]), t)) if hot[n] else F.col(n)
        return [bits_of(F.col(n), hot[n]).alias(f"{n}_hot"), cold.alias(f"{n}_cold"), F.aggregate(cold, F.lit(0).cast("bigint"), lambda a, t: a.bitwiseOR(bit(t))).alias(f"{n}_mask")]

    def pack(df: DataFrame) -> DataFrame:
        return df.select("*", *[c for n in families for c in packed(n)])

    return durable(pack(left), "packed"), durable(pack(right), "packed"), hot


def _cold(n: str) -> Column:
    return F.array_intersect(f"{n}_cold", f"{n}_cold_r")


def _hot(n: str) -> Column:
    return F.col(f"{n}_hot").bitwiseAND(F.col(f"{n}_hot_r"))


def _no_cold(n: str) -> Column:
    return F.col(f"{n}_mask").bitwiseAND(F.col(f"{n}_mask_r")) == 0


def shared_size(n: str) -> Column:
    """How many tags of a packed set two rows share; the columns of the right one end in ``_r``."""
    return F.bit_count(_hot(n)).cast("int") + F.when(_no_cold(n), 0).otherwise(F.size(_cold(n)))


def shares_any(n: str) -> Column:
    """Whether two rows share a tag of a packed set."""
    return (_hot(n) != 0) | (~_no_cold(n) & F.arrays_overlap(f"{n}_cold", f"{n}_cold_r"))


def first_shared(n: str, tag: Column, bit: Column) -> Column:
    """Whether ``tag`` (whose bit is ``bit``, 0 without one) is the first tag of the packed set that two rows share."""
    hot = _hot(n)
    return F.when(bit != 0, bit == hot.bitwiseAND(F.negative(hot))).otherwise((hot == 0) & (tag == F.get(_cold(n), F.lit(0))))


def keyed_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: list[str]) -> DataFrame:
    """Rows of ``left`` and ``right`` joined by ``keys``, one at most of which has many rows on either side. Columns of ``right`` must differ in name.

    Only rows are shuffled, never pairs. A key that forms more than ``CELL`` pairs is cut into a grid, whose cells are
    tasks; each side is repeated for one dimension of it.
    """
    n = lambda df, c: df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).groupBy(*keys).agg(F.count(F.lit(1)).alias(c))
    work = n(left, "_nl").join(n(right, "_nr"), keys).withColumn("_cells", F.ceil(F.sqrt(F.col("_nl").cast("double") * F.col("_nr") / CELL)).cast("int"))
    grid = F.broadcast(work.where("_cells > 1").orderBy(F.desc("_cells"), *keys).limit(HOT_SHARES).select(*keys, "_cells"))

    def cut(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        cells = F.coalesce("_cells", F.lit(1))
        return df.join(grid, keys, "left").withColumn(own, F.pmod(F.xxhash64(key), cells.cast("bigint")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), cells - 1))).drop("_cells")

    return cut(left, left_id, "_a", "_b").join(cut(right, right_id, "_b", "_a"), [*keys, "_a", "_b"]).drop("_a", "_b")


def _lookup(names: list[str]) -> dict[str, list[tuple[int, set[str]]]]:
    """The names by their first characters (at most ``HEAD``) and length."""
    out: dict[str, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
    for n in names:
        out[n[:HEAD]][len(n)].add(n)
    return {head: sorted(by.items()) for head, by in out.items()}


def contained(texts: DataFrame, names: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """``(key, name)``: every name that occurs in a text, whole texts and all names. Blank names occur in none.

    Distinct names are broadcast in blocks; each place of a text is looked up by the beginnings of names.
    """
    spark = texts.sparkSession
    names = durable(names.select(name).where(F.col(name) != "").distinct(), "names")
    blocks = max(1, -(-names.count() // BLOCK))

    def of_block(k: int) -> DataFrame:
        rows = names.where(F.pmod(F.xxhash64(name), F.lit(blocks)) == k).toPandas()
        heads = spark.sparkContext.broadcast(_lookup(rows[name].tolist()))

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = heads.value
            for b in batches:
                got = []
                for i, t in zip(b[key], b[text], strict=True):
                    hits = {t[at : at + n] for at in range(len(t)) for h in range(1, HEAD + 1) for n, some in known.get(t[at : at + h], ()) if (n == h or h == HEAD) and t[at : at + n] in some}
                    got += [(i, x) for x in hits]
                yield pd.DataFrame(got, columns=[key, name])

        return texts.where(F.col(text) != "").select(key, text).mapInPandas(find, f"`{key}` {dict(texts.dtypes)[key]}, `{name}` string")

    return reduce(DataFrame.unionByName, map(of_block, range(blocks)))


@dataclass(frozen=True)
class Bonus:
    """``base`` + ``step`` x min(n, ``most``) if the pair shares ``family`` at all."""

    family: str
    base: int
    step: int
    most: int

    def points(self) -> Column:
        n = F.col(f"n_{self.family}")
        return F.when(n > 0, self.base + self.step * F.least(n, F.lit(self.most))).otherwise(0)


#: What shared families are worth, by generation of the scoring.
SCORES: dict[str, list[Bonus]] = {
    "v3": [Bonus("signature", 36, 6, 2), Bonus("visual", 22, 4, 4), Bonus("knowledge", 0, 4, 3)],
    "v4": [Bonus("visual", 28, 6, 3), Bonus("background", 22, 5, 2), Bonus("task", 22, 5, 3), Bonus("method", 24, 5, 3), Bonus("core", 28, 5, 2)],
}
SCORES["v5"] = [*SCORES["v4"], Bonus("task_model", 70, 8, 2)]
#: Points for equal types, and the least score, by generation.
SAME_TYPE = {"v3": 24, "v4": 30, "v5": 30}
LEAST = {"v3": 76, "v4": 105, "v5": 105}
#: Points of a part of the evidence for each tag it shares with the question, and the most the best part adds.
EVIDENCE = {"v4": {"visual": 10, "task": 6, "method": 6}, "v5": {"visual": 10, "task": 6, "task_model": 14, "method": 6}}
MOST = {"v3": 28, "v4": 25, "v5": 25}
#: The type of which two add 30 points (with evidence, from v4).
PROJECT = "项目式探究题"


def family_score(generation: str, same_type: Column) -> Column:
    """The additive score of a pair with counts ``n_<family>``."""
    total = F.when(same_type, SAME_TYPE[generation]).otherwise(0)
    for b in SCORES[generation]:
        total = total + b.points()
    return total.cast("int")


def audit_score(same_type: Column, close: Column, composite: Column) -> dict[str, Column]:
    """Score, filter and grade of a pair by signature, or by type with knowledge and problem tags.

    Needs ``n_signature``, ``n_knowledge``, ``n_problem`` and ``n_method``; ``close`` says that the difficulties
    differ by one at most, ``composite`` that the question is of a type that needs a shared model or method.
    """
    sig, kn, pr, me = (F.col(f"n_{x}") for x in ("signature", "knowledge", "problem", "method"))
    by_sig, by_type = sig > 0, same_type & (kn > 0) & (pr > 0)
    base = F.when(by_sig, 58 + 8 * F.least(sig, F.lit(3))).when(by_type, 38 + 8 * F.least(kn, F.lit(3)) + 10 * F.least(pr, F.lit(2)))
    more = (
        F.when(same_type, 10).otherwise(0) + 5 * F.least(kn, F.lit(4)) + 6 * F.least(pr, F.lit(3)) + F.when(me > 0, 8).otherwise(0) + F.when(close, 4).otherwise(0)
    )
    barred = composite & ~((sig > 0) | (me > 0))
    raw = base + more
    score = F.when(base.isNull(), 0).when(barred, F.least(raw, F.lit(49))).otherwise(raw).cast("int")
    passes = base.isNotNull() & ~barred
    grade = F.when(passes & by_sig & (score >= 82), "完美巩固").when(passes & by_sig & (score >= 72), "进阶变式").otherwise("不推荐")
    return {"score": score, "passes": passes, "grade": grade}
