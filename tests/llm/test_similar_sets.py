import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from sievemark.llm.similar_sets import EXACT_SIZE, SKETCH_BITS, Plan, segment_keys, set_members, similar_classes, similar_links, similar_pairs, sketches


def frame(spark, rows):
    return spark.createDataFrame([(g, r, v, 1, 2) for g, r, v in rows], "field string, id string, vals array<string>, cid int, tags int")


def brute(rows, t):
    sets = {}
    for g, r, v in rows:
        s = frozenset(x for x in v or () if x is not None)
        if r is not None and s:
            sets.setdefault((g, r), set()).add(s)
    out = set()
    keys = sorted(sets, key=str)
    for i, (g, a) in enumerate(keys):
        for h, b in keys[i + 1 :]:
            if g == h and any(Fraction(len(x & y), len(x | y)) >= t for x in sets[g, a] for y in sets[h, b]):
                out.add((g, *sorted((a, b))))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = ["common", "usual"] + [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):
        base = ["common"] * (i % 3 == 0) + rng.sample(words, rng.randint(1, 8))
        rows.append(("f" if i % 4 else "g", f"r{i}", base))
        if i % 2:
            changed = base[:]
            changed[rng.randrange(len(changed))] = rng.choice(words)
            rows.append(("f" if i % 4 else "g", f"s{i}", changed + changed[:1]))
    rows += [("f", None, ["a"]), ("f", "n1", None), ("f", "n2", []), ("f", "n3", [None, "x"]), ("f", "n4", ["x"]), ("f", "r1", ["z1", "z2"]), ("f", "dup", ["z1", "z2"]), ("f", "dup", ["z1", "z2"])]
    t = Fraction(3, 5)
    got = {tuple(r) for r in similar_pairs(set_members(frame(spark, rows), "field", "id", "vals"), t).collect()}
    want = brute(rows, t)
    assert got <= want and len(got) >= 0.999 * len(want) - 1 and ("f", "n3", "n4") in got


def test_hot_set_costs_one_class(spark):
    rows = [("f", f"r{i}", ["a", "b", "c"]) for i in range(3000)] + [("f", "x", ["a", "b", "c", "d"]), ("f", "y", ["q"])]
    m = set_members(frame(spark, rows), "field", "id", "vals")
    assert similar_classes(m).count() == 1
    links = {r.record: r for r in similar_links(m).collect()}
    assert (links["r7"].class_id, links["r7"].n_copies, links["r7"].n_links) == ("r0", 2999, 1)
    assert (links["x"].n_copies, links["x"].n_links, links["y"].n_links) == (0, 3000, 0)


def test_empty(spark):
    m = set_members(frame(spark, [("f", "a", ["x"])]).limit(0), "field", "id", "vals")
    assert similar_pairs(m).count() == 0 and similar_links(m).count() == 0


def test_long_sets(spark):
    a = [f"t{i}" for i in range(5000)]
    rows = [("f", "a", a), ("f", "b", a[:4000]), ("f", "c", a[:2000])]
    assert {tuple(r) for r in similar_pairs(set_members(frame(spark, rows), "field", "id", "vals")).collect()} == {("f", "a", "b")}


def test_calibration():
    plan = Plan.of(Fraction(3, 5))
    assert 20 <= plan.radius <= 28 and SKETCH_BITS == 64
    assert plan.segments(1) == ({}, [1]) and plan.segments(3) == ({}, [2, 3]) and plan.segments(4)[1] == [3]
    some, every = plan.segments(9)
    assert every == [] and list(some) == [3] and 25 <= some[3] <= 45 and plan.segments(33_000)[0][3] < 45
    rng = np.random.default_rng(0)
    for a, b in ((8, 8), (6, 10), (4, 6), (5, 8), (7, 11), (12, 20), (40, 40)):
        o, met, far = -(-3 * (a + b) // 8), 0, 0
        for _ in range(300):
            x = rng.integers(1, 1 << 60, a + b - o)
            pair = [x[:a], x[a - o :]]
            ka, kb = segment_keys(pair, plan)
            met += bool(set(ka.tolist()) & set(kb.tolist()))
            w = sketches(pair)
            far += bin(int(w[0] ^ w[1]) & (2**64 - 1)).count("1") > plan.radius
        assert met >= 298 and far <= 2, (a, b, met, far)


def test_small_sets_always_meet():
    plan, rng = Plan.of(Fraction(3, 5)), random.Random(1)
    pool = list(range(1, 9))
    sets = [np.array(rng.sample(pool, rng.randint(1, EXACT_SIZE))) * 7_919 for _ in range(300)]
    keys = [set(k.tolist()) for k in segment_keys(sets, plan)]
    for i, a in enumerate(sets):
        for j in range(i):
            x, y = set(a.tolist()), set(sets[j].tolist())
            if Fraction(len(x & y), len(x | y)) >= plan.threshold:
                assert keys[i] & keys[j]
    assert segment_keys([], plan) == [] and sketches([]).shape == (0,)


def test_sets_beyond_a_short(spark):
    from pyspark.sql import functions as F

    from sievemark.llm.similar_sets import similar_classes

    tags = F.transform(F.sequence(F.col("id") + 1, F.col("id") + 33_000), lambda x: x.cast("string"))
    members = spark.range(2).select(F.lit("g").alias("grp"), F.array_sort(tags).alias("tags"), F.col("id").alias("cid"))
    assert [(r.n_shared, r.n_union) for r in similar_classes(members).select("n_shared", "n_union").collect()] == [(32_999, 33_001)]


def test_hot_segments_are_spread(spark):
    """Many different sets that share all but one value meet in the same segments."""
    rows = [("f", f"r{i}", ["a", "b", "c", "d", f"x{i}"]) for i in range(300)]
    got = similar_classes(set_members(frame(spark, rows), "field", "id", "vals")).count()
    assert got == 300 * 299 // 2
