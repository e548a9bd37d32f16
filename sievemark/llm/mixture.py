"""Mixing sources to target weights, by min-cost flow.

A document is a text; it belongs to every source that has it. Documents are aggregated by membership
pattern (the set of their sources), and the tokens of a pattern are its supply, once per use. Tokens flow
from patterns to source quotas; the k-th use of a pattern costs k - 1, so costs are convex and copies are
used before none is left unused. The flow is then laid out along the seeded order of each pattern's
documents, which gives each document its number of uses for each source.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemark.session import durable

#: Where the vocabulary files of public tokenizers lie; every executor has them.
TOKENIZERS = "/opt/tokenizers"
#: Texts in a slice of a pattern's seeded order, about; running sums are taken within one slice only.
SLICE_TEXTS = 50_000
#: Membership patterns, at most: they are the nodes of the flow. Beyond, sources have to be put together first.
MAX_PATTERNS = 20_000
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def count_tokens(folder: str = TOKENIZERS, name: str = "byte_bpe_multi_50k.tiktoken"):  # noqa: ANN201
    """A column function: the number of tokens of a text by the rank file ``folder``/``name``; 0 for null."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(os.path.join(folder, name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tool = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield texts.map(lambda t: 0 if t is None else len(tool.encode_ordinary(t))).astype("int64")

    return count


class _Flow:
    """Successive shortest paths on a small graph with real capacities."""

    def __init__(self, n: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[float] = []
        self.cost: list[float] = []

    def arc(self, a: int, b: int, cap: float, cost: float = 0.0) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0.0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, s: int, t: int, eps: float) -> float:
        n, total = len(self.out), 0.0
        potential = [0.0] * n
        while True:
            dist, via = [float("inf")] * n, [-1] * n
            dist[s] = 0.0
            heap = [(0.0, s)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                for e in self.out[u]:
                    v = self.to[e]
                    x = d + self.cost[e] + potential[u] - potential[v]
                    if self.cap[e] > eps and x < dist[v] - 1e-12:
                        dist[v], via[v] = x, e
                        heapq.heappush(heap, (x, v))
            if via[t] < 0:
                return total
            potential = [p + d if d < float("inf") else p for p, d in zip(potential, dist, strict=True)]
            push, v = float("inf"), t
            while v != s:
                push = min(push, self.cap[via[v]])
                v = self.to[via[v] ^ 1]
            v = t
            while v != s:
                self.cap[via[v]] -= push
                self.cap[via[v] ^ 1] += push
                v = self.to[via[v] ^ 1]
            total += push


@dataclass(frozen=True)
class Target:
    """The share of all tokens a source is to have, and how often one of its documents may be used at most."""

    source: str
    share: float
    repeats: int


def route(supply: dict[tuple[str, ...], int], targets: list[Target], total: float | None = None) -> tuple[float, dict[tuple[tuple[str, ...], str], float]]:
    """The tokens to take of each pattern for each source, and the size of the mixture.

    ``supply`` has the tokens of each pattern. Without ``total`` the mixture is the largest in which every
    source that has documents gets its share; with it, sources that are too scarce give all they may. Sources
    without documents get nothing, and the rest keep their proportions to each other.
    """
    want = {t.source: t for t in targets}
    patterns = [p for p, w in sorted(supply.items()) if w > 0 and any(s in want for s in p)]
    have = sorted({s for p in patterns for s in p if s in want and want[s].share > 0 and want[s].repeats > 0})
    if not have:
        return 0.0, {}
    weight = {s: want[s].share / sum(want[x].share for x in have) for s in have}
    size = sum(supply[p] for p in patterns)

    def solve(amount: float) -> tuple[float, dict]:
        at = {p: 1 + i for i, p in enumerate(patterns)}
        src = {s: 1 + len(patterns) + i for i, s in enumerate(have)}
        end = 1 + len(patterns) + len(have)
        g = _Flow(end + 1)
        arcs = {}
        for p in patterns:
            own = [s for s in p if s in src]
            for k in range(max(want[s].repeats for s in own) if own else 0):
                g.arc(0, at[p], float(supply[p]), float(k))
            for s in own:
                arcs[p, s] = g.arc(at[p], src[s], float(supply[p]) * want[s].repeats)
        for s in have:
            g.arc(src[s], end, weight[s] * amount)
        flow = g.run(0, end, size * 1e-12)
        return flow, {k: g.cap[e ^ 1] for k, e in arcs.items() if g.cap[e ^ 1] > size * 1e-12}

    if total is not None:
        return float(total), solve(total)[1]
    low, high = 0.0, float(size) * max(want[s].repeats for s in have)
    if solve(high)[0] >= high * (1 - 1e-9):
        return high, solve(high)[1]
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if solve(mid)[0] >= mid * (1 - 1e-9) else (low, mid)
    return low, solve(low)[1]


def _texts(docs: DataFrame, counter, key: str, text: str, source: str, merge_copies: bool) -> DataFrame:  # noqa: ANN001
    """``(h1, h2, source, doc, n)``: each text of each source once, with the least key of the documents that have it; without
    ``merge_copies`` each key is a text of its own."""
    rows = docs.where(F.col(text).isNotNull() & F.col(source).isNotNull() & F.col(key).isNotNull())
    own = [] if merge_copies else [F.col(key)]
    slim = rows.select(F.xxhash64(text, *own).alias("h1"), F.xxhash64(F.lit("other"), F.col(text), *own).alias("h2"), F.col(source).alias("source"), F.col(key).alias("doc"), counter(F.col(text)).alias("n"))
    return slim.groupBy("h1", "h2", "source").agg(F.min("doc").alias("doc"), F.first("n").alias("n")).where(F.col("n") > 0)


def mix(
    docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total: float | None = None, seed: int = 0,
    tokenizers: str = TOKENIZERS, slice_texts: int = SLICE_TEXTS, merge_copies: bool = True, max_patterns: int = MAX_PATTERNS,
) -> DataFrame:
    """The mixture: ``(key, source, n_tokens, n_uses)``, a row per text and source it is used for.

    ``targets`` has ``source``, ``target_share`` and ``max_repeats`` (a small table; its rows come to the
    driver, as does the token sum of each membership pattern of the sources named there). Each source gets
    its share of all tokens to within one document. A text is used for a source ``max_repeats`` times at
    most, and in all no oftener than the largest ``max_repeats`` of its sources. Equal texts of one source
    are one document, with the least key, so that copies don't count as repeats that nobody sees; without ``merge_copies``
    each key is a document, and its copies add to the supply. Null and empty texts, null sources and sources without a target
    take no part; a source without documents gets nothing (see ``mixture_report``). Of repeated targets for
    a source the greatest counts; null shares and repeats are 0. The order of documents depends on ``seed``
    and the text alone. Shares are met for any row order and partitioning. More than ``max_patterns`` membership patterns
    raise a ValueError: they are collected for the flow.
    """
    want = [Target(r["source"], r["share"], r["repeats"]) for r in targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.coalesce(F.max("target_share"), F.lit(0.0)).cast("double").alias("share"), F.coalesce(F.max("max_repeats"), F.lit(0)).cast("int").alias("repeats")).orderBy("source").collect()]
    named = [t.source for t in want if t.share > 0 and t.repeats > 0]
    texts = durable(_texts(docs.where(F.col(source).isin(named)) if named else docs.limit(0), count_tokens(tokenizers), key, text, source, merge_copies), "tokens")
    whole = texts.groupBy("h1", "h2").agg(F.array_sort(F.collect_set("source")).alias("pattern"), F.first("n").alias("n"))
    slices = max(64, texts.count() // slice_texts)
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "h1", "h2"), 1)
    whole = whole.withColumn("place", place).withColumn("slice", F.floor(F.col("place") / F.lit(float(1 << 63)) * slices).cast("int"))
    sums = durable(whole.groupBy("pattern", "slice").agg(F.sum("n").alias("n")), "slices")
    rows = sums.groupBy("pattern").agg(F.sum("n").alias("w")).limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError(f"the sources overlap in more than {max_patterns} patterns; put sources together or raise max_patterns")
    supply = {tuple(r["pattern"]): int(r["w"]) for r in rows}
    _, flow = route(supply, want, total)
    spans, done = [], {}
    for (p, s), amount in sorted(flow.items()):
        a = done.get(p, 0.0)
        done[p] = a + amount / supply[p]
        spans.append((list(p), s, a, done[p], float(supply[p])))
    spark = docs.sparkSession
    plan = spark.createDataFrame(spans, "pattern array<string>, source string, a double, b double, supply double")
    by_slice = Window.partitionBy("pattern").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("pattern", "slice", F.coalesce(F.sum("n").over(by_slice), F.lit(0)).alias("base"))
    in_slice = Window.partitionBy("pattern", "slice").orderBy("place", "h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
    spot = whole.withColumn("before", F.coalesce(F.sum("n").over(in_slice), F.lit(0))).join(base, ["pattern", "slice"])
    used = spot.join(F.broadcast(plan), "pattern").withColumn("x", (F.col("base") + F.col("before")) / F.col("supply"))
    uses = F.ceil(F.col("b") - F.col("x") - 1e-12) - F.ceil(F.col("a") - F.col("x") - 1e-12)
    chosen = used.withColumn("n_uses", uses.cast("int")).where(F.col("n_uses") > 0).select("h1", "h2", "source", "n_uses")
    return chosen.join(texts, ["h1", "h2", "source"]).select(F.col("doc").alias(key), F.col("source").alias("source"), F.col("n").alias("n_tokens"), "n_uses")


def mixture_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of ``targets``: the target share, the actual one, documents, tokens, uses and the most uses of one document."""
    per = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_uses").alias("n_uses"), F.sum(F.col("n_uses") * F.col("n_tokens")).alias("n_tokens"), F.max("n_uses").alias("most_uses"))
    want = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    every = want.join(F.broadcast(per), "source", "left").fillna(0, ["n_documents", "n_uses", "n_tokens", "most_uses"])
    whole = per.agg(F.sum("n_tokens").alias("t"))
    share = F.coalesce(F.col("n_tokens") / F.nullif(whole.scalar(), F.lit(0)), F.lit(0.0))
    return every.select("source", "target_share", share.alias("actual_share"), "max_repeats", "most_uses", "n_documents", "n_uses", "n_tokens")
