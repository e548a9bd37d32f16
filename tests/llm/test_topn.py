import random

from sievemark.llm.topn import group_thresholds, score_bin, top_n
from pyspark.sql import functions as F


def brute(rows, n):
    best = {}
    for g, i, s in rows:
        if g and i and s is not None and s == s:
            best.setdefault(g, {})
            best[g][i] = max(best[g].get(i, float("-inf")), s)
    return {(g, k + 1, i, s) for g, m in best.items() for k, (i, s) in enumerate(sorted(m.items(), key=lambda x: (-x[1], x[0]))[:n])}


def run(spark, rows, n, **kw):
    df = spark.createDataFrame([(g, i, s, "x", 1) for g, i, s in rows], "q string, v string, score double, g string, least_bin int")
    return {tuple(r) for r in top_n(df, "q", "v", "score", n, **kw).collect()}


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for k in range(4000):
        g = "hot" if k % 3 == 0 else rng.choice(["", None]) if k % 50 == 1 else f"q{rng.randint(0, 300)}"
        s = rng.choice([None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, -5.5]) if k % 20 == 2 else rng.choice([50.0, 50.5, 99.5, rng.random() * 100])
        rows.append((g, rng.choice([None, "", *(f"v{j}" for j in range(200))]), s))
    rows += rows[:500]
    for n in (1, 3, 10):
        for kw in ({}, {"heavy_rows": 5, "heavy_shares": 1000}, {"heavy_rows": 10**9}):
            assert run(spark, rows, n, **kw) == brute(rows, n)


def test_ties_of_a_heavy_group(spark):
    rows = [("hot", f"v{i:05d}", 7.0) for i in range(20_000)] + [("q", "a", 1.0)]
    assert run(spark, rows, 3, heavy_rows=100) == {("hot", 1, "v00000", 7.0), ("hot", 2, "v00001", 7.0), ("hot", 3, "v00002", 7.0), ("q", 1, "a", 1.0)}


def test_thresholds_are_safe_with_repeats(spark):
    df = spark.createDataFrame([("g", "a", 9.0)] * 50 + [("g", "b", 5.0), ("g", "c", 1.0)], "g string, i string, s double")
    least = group_thresholds(df, 3).first()
    assert least.least_bin <= df.select(score_bin(F.lit(1.0)).alias("b")).first().b


def test_bins_never_fall(spark):
    values = [float("-inf"), -1e300, -7.0, -1e-9, 0.0, 1e-9, 0.5, 1.0, 55.5, 56.0, 1e300, float("inf")]
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "s double").select(score_bin(F.col("s")).alias("b")).collect()]
    assert got == sorted(got)


def test_empty(spark):
    df = spark.createDataFrame([], "q string, v string, score double")
    assert top_n(df, "q", "v", "score", 3).count() == 0
