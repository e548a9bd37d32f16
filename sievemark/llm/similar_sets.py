"""All similar pairs of set-valued records, by multi-index binary sketches.

Each distinct set gets a binary sketch: the lowest bit of its minhash under each of ``SKETCH_BITS``
permutations. Two sets of Jaccard similarity J agree in a bit with probability (1 + J) / 2, so a Hamming
radius with a calibrated recall follows from the binomial distribution.

The index over the sketches is made of segments. A segment packs the bits of the ``order`` least hash
values of one permutation (its bottom values), so it agrees as a whole if these values do. By the
pigeonhole principle sets within the threshold share at least ``o`` values, and bottom values that all lie
among the shared ones agree. How many segments a set has is calibrated to the target recall for the least favourable
partner of its size. Sets of ``EXACT_SIZE`` values and fewer have so few choices of ``order`` values that all
of them are segments: pairs of such sets always meet. Pairs that meet in a segment and lie within the radius are
verified with the sets.

Packing segments of *independent* one-bit minhashes instead would need some 900 segments of 22 bits at a
threshold of 0.6 (each bit agrees with probability 0.8 only); see the README for figures.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemark.operators.joins import salted_join
from sievemark.session import durable

#: Bits of the sketch, a 64-bit word.
SKETCH_BITS = 64
#: Sets of so many values and fewer have a segment for every choice of their values.
EXACT_SIZE = 5
_GOLDEN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


@dataclass(frozen=True)
class Plan:
    """What follows from a threshold and a target recall: ``order`` bottom values a segment, and the ``radius``."""

    threshold: Fraction
    recall: float
    order: int
    radius: int

    @staticmethod
    def of(threshold: Fraction, recall: float = 0.999, order: int = 3) -> Plan:
        """``recall`` is a floor for pairs right at the threshold; the radius misses a tenth of what the segments may miss."""
        differ = (1 - float(threshold)) / 2
        miss, radius, term = 1.0, -1, (1 - differ) ** SKETCH_BITS
        while miss > (1 - recall) / 10:
            radius += 1
            miss -= term
            term *= (SKETCH_BITS - radius) / (radius + 1) * differ / (1 - differ)
        return Plan(threshold, recall, order, radius)

    def segments(self, size: int) -> tuple[dict[int, int], list[int]]:
        """For a set of ``size`` values: how many segments of how many bottom values it has, and of how many values it packs
        every choice. Fewer than ``order`` values are packed to meet sets with which it shares no more."""
        num, den = self.threshold.numerator, self.threshold.denominator
        other = np.arange(-(-size * num // den), size * den // num + 1)
        shared = -(-num * (size + other) // (num + den))
        other, shared = other[shared <= np.minimum(size, other)], shared[shared <= np.minimum(size, other)]
        union = size + other - shared
        order = np.minimum(shared, self.order)
        both_small = np.maximum(size, other) <= EXACT_SIZE
        some: dict[int, int] = {}
        for r in set(order[~both_small].tolist()):
            at = ~both_small & (order == r) & (union > shared)
            agree = np.prod([(shared[at] - i) / (union[at] - i) for i in range(r)], axis=0)
            if len(agree):
                some[r] = max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - agree.min())))
        return some, sorted(set(order[both_small].tolist()))


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixing function; another permutation of the values for each seed."""
    x = x + np.uint64((seed * _GOLDEN + 0x1234567) & _MASK)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _flat(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashed values of non-empty sets one after the other, where each set starts, and the set of each value."""
    size = np.array([len(v) for v in values])
    flat = np.concatenate(values).astype(np.int64).view(np.uint64)
    return flat, np.concatenate([[0], np.cumsum(size)[:-1]]), np.repeat(np.arange(len(values)), size)


def sketches(values: list[np.ndarray]) -> np.ndarray:
    """The sketch of each set of hashed values. All sets are non-empty."""
    words = np.zeros(len(values), dtype=np.uint64)
    if len(values):
        flat, start, _ = _flat(values)
        for p in range(SKETCH_BITS):
            words |= (np.minimum.reduceat(_mix(flat, p), start) & np.uint64(1)) << np.uint64(p)
    return words.view(np.int64)


def _packed(columns: list[np.ndarray], seed: int) -> np.ndarray:
    key = _mix(np.full(len(columns[0]), seed, dtype=np.uint64), 1_000_003)
    for r, c in enumerate(columns, 1):
        key = _mix(key ^ c, r)
    return key


def segment_keys(values: list[np.ndarray], plan: Plan) -> list[np.ndarray]:
    """The segments of each set of hashed values, as hashes. All sets are non-empty."""
    owners: list[np.ndarray] = []
    found: list[np.ndarray] = []
    sizes = np.array([len(v) for v in values], dtype=np.int64)
    plans = {int(s): plan.segments(int(s)) for s in np.unique(sizes)}
    for s, (_, every) in plans.items():
        if every:
            at = np.flatnonzero(sizes == s)
            table = np.sort(np.stack([values[i] for i in at]).astype(np.int64).view(np.uint64), axis=1)
            for r in every:
                for choice in itertools.combinations(range(s), r):
                    owners.append(at)
                    found.append(_packed([table[:, c] for c in choice], r))
    wanted = np.array([[plans[int(s)][0].get(r, 0) for r in range(plan.order + 1)] for s in sizes], dtype=np.int64).reshape(-1, plan.order + 1)
    active = np.zeros(0, dtype=np.int64)
    for p in range(int(wanted.max(initial=0))):
        now = np.flatnonzero(wanted.max(axis=1) > p)
        if p == 0 or len(now) < len(active):
            active = now
            flat, start, owner = _flat([values[i] for i in active])
        h, columns = _mix(flat, 1_000 + p), []
        for r in range(1, plan.order + 1):
            columns.append(np.minimum.reduceat(h, start))
            use = wanted[active, r] > p
            if use.any():
                owners.append(active[use])
                found.append(_packed([c[use] for c in columns], 100 + plan.order * p + r))
            h[h == columns[-1][owner]] = np.uint64(_MASK)
    if not found:
        return [np.zeros(0, dtype=np.int64) for _ in values]
    owner, key = np.concatenate(owners), np.concatenate(found).view(np.int64)
    order = np.argsort(owner, kind="stable")
    return np.split(key[order], np.cumsum(np.bincount(owner, minlength=len(values)))[:-1])


@F.pandas_udf(T.LongType())
def _sketch(hashed: pd.Series) -> pd.Series:
    return pd.Series(sketches([np.asarray(v) for v in hashed]))


def _segment_udf(plan: Plan):  # noqa: ANN202
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def segments(hashed: pd.Series) -> pd.Series:
        return pd.Series(segment_keys([np.asarray(v) for v in hashed], plan), dtype=object)

    return segments


def set_members(df: DataFrame, group: str, record: str, values: str) -> DataFrame:
    """``(grp, record, tags, cid)``: each record's set of values, sorted and without repeats, and the hash of the set.

    Null values in a set are dropped; records with a null id or without values are left out; a record
    that occurs with several rows in a group has each of its different sets (and each row stays).
    """
    tags = F.array_sort(F.array_distinct(F.filter(F.col(values), lambda v: v.isNotNull())))
    rows = df.where(F.col(record).isNotNull()).select(F.col(group).alias("grp"), F.col(record).alias("record"), tags.alias("tags"))
    return rows.where(F.size("tags") > 0).withColumn("cid", F.xxhash64("grp", "tags"))


def _second() -> Column:
    """A second hash of a set: both name the class of equal sets, so that sets themselves are not shuffled to find it."""
    return F.xxhash64(F.lit("other"), "grp", "tags")


def similar_classes(members: DataFrame, threshold: Fraction = Fraction(3, 5), recall: float = 0.999) -> DataFrame:
    """``(grp, cid_a, c2_a, tags_a, cid_b, c2_b, tags_b, n_shared, n_union)``: pairs of different sets of one group whose
    Jaccard similarity is ``threshold`` or more, each once (``cid_a`` < ``cid_b``).

    Equal sets are one class whatever the number of records, so copies cost nothing here. ``recall`` is the
    floor for pairs exactly at the threshold: so many meet in a segment, and of these the radius leaves out
    (1 - ``recall``) / 10 at most. Pairs of sets of ``EXACT_SIZE`` values and fewer all meet. Verification is exact.
    Segments that no other set has are dropped before the join; of segments that many sets have, one side is
    spread over salts.
    """
    plan = Plan.of(threshold, recall)
    hashed = F.transform("tags", lambda v: F.xxhash64(v))
    one = members.groupBy("cid", _second().alias("c2")).agg(F.first("grp").alias("grp"), F.first("tags").alias("tags"))
    classes = durable(one.withColumn("w", _sketch(hashed)), "sketches")
    index = classes.select("cid", F.size("tags").alias("n"), F.xxhash64("grp").alias("g"), F.explode(_segment_udf(plan)(hashed)).alias("k"))
    index = index.select(F.col("k").bitwiseXOR(F.col("g")).alias("k"), "cid", "n")
    in_segment = Window.partitionBy("k").orderBy("cid")
    shared_by = F.lag("cid").over(in_segment).isNotNull() | F.lead("cid").over(in_segment).isNotNull()
    index = durable(index.withColumn("shared", shared_by).where("shared").select("k", "cid", "n"), "index")
    a = index.select("k", F.col("cid").alias("cid_a"), F.col("n").alias("n_a"))
    b = index.select("k", F.col("cid").alias("cid_b"), F.col("n").alias("n_b"))
    num, den = threshold.numerator, threshold.denominator
    sizes = (F.col("n_a") * den >= F.col("n_b") * num) & (F.col("n_b") * den >= F.col("n_a") * num)
    met = salted_join(a, b, ["k"], spread=F.col("cid_a"), how="inner").where((F.col("cid_a") < F.col("cid_b")) & sizes).select("cid_a", "cid_b").distinct()

    def side(x: str) -> DataFrame:
        return classes.select(*[F.col(c).alias(f"{c}_{x}") for c in ("grp", "cid", "c2", "tags", "w")])

    near = F.bit_count(F.col("w_a").bitwiseXOR(F.col("w_b"))) <= plan.radius
    same = F.col("grp_a").eqNullSafe(F.col("grp_b")) & (F.col("tags_a") != F.col("tags_b"))
    both = met.join(side("a"), "cid_a").join(side("b"), "cid_b").where(same & near)
    shared: Column = F.size(F.array_intersect("tags_a", "tags_b"))
    counted = both.withColumn("n_shared", shared).withColumn("n_union", F.size("tags_a") + F.size("tags_b") - F.col("n_shared"))
    hit = counted.where(F.col("n_shared") * den >= F.col("n_union") * num)
    return hit.select(F.col("grp_a").alias("grp"), "cid_a", "c2_a", "tags_a", "cid_b", "c2_b", "tags_b", "n_shared", "n_union")


def similar_pairs(members: DataFrame, threshold: Fraction = Fraction(3, 5), recall: float = 0.999) -> DataFrame:
    """``(grp, id_a, id_b)``: all pairs of records of a group, ``id_a`` < ``id_b``, with sets at least ``threshold`` similar.

    The pairs of classes are expanded to their records, and records with equal sets are paired (those of a set with many
    records in salted parts). If one set had a third of all records that would be most of all pairs; where copies
    abound, use ``similar_links``, which has representatives and membership instead.
    """
    m = durable(members.select("grp", "cid", _second().alias("c2"), "tags", "record"), "members")
    pairs = similar_classes(m, threshold, recall).select("cid_a", "c2_a", "cid_b", "c2_b")
    left = m.select("grp", F.col("cid").alias("cid_a"), F.col("c2").alias("c2_a"), F.col("record").alias("r1"))
    right = m.select(F.col("cid").alias("cid_b"), F.col("c2").alias("c2_b"), F.col("record").alias("r2"))
    across = pairs.join(left, ["cid_a", "c2_a"]).join(right, ["cid_b", "c2_b"]).select("grp", "r1", "r2")
    same = salted_join(left, right.withColumnsRenamed({"cid_b": "cid_a", "c2_b": "c2_a"}), ["cid_a", "c2_a"], spread=F.col("r1"), how="inner").where("r1 < r2").select("grp", "r1", "r2")
    both = across.unionByName(same).where(F.col("r1") != F.col("r2"))
    return both.select("grp", F.least("r1", "r2").alias("id_a"), F.greatest("r1", "r2").alias("id_b")).distinct()


def similar_links(members: DataFrame, threshold: Fraction = Fraction(3, 5), recall: float = 0.999) -> DataFrame:
    """``(grp, record, class_id, n_copies, n_links)``: one row per record and set, with its class of equal sets, the
    number of other records in the class, and of records in other classes that are similar. Copies are never expanded.
    """
    m = durable(members.select("grp", "cid", _second().alias("c2"), "tags", "record"), "members")
    records = m.select("grp", "cid", "c2", "record").distinct()
    sizes = records.groupBy("cid", "c2").agg(F.count(F.lit(1)).alias("size"), F.min("record").alias("class_id"))
    pairs = similar_classes(m, threshold, recall)
    way = lambda a, b: pairs.select(*[F.col(f"{c}_{a}").alias(c) for c in ("cid", "c2")], *[F.col(f"{c}_{b}").alias(f"other_{c}") for c in ("cid", "c2")])
    other = sizes.select(F.col("cid").alias("other_cid"), F.col("c2").alias("other_c2"), "size")
    links = way("a", "b").unionByName(way("b", "a")).join(other, ["other_cid", "other_c2"]).groupBy("cid", "c2").agg(F.sum("size").alias("n_links"))
    info = sizes.join(links, ["cid", "c2"], "left").select("cid", "c2", "class_id", (F.col("size") - 1).alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    return records.join(info, ["cid", "c2"]).select("grp", "record", "class_id", "n_copies", "n_links")
