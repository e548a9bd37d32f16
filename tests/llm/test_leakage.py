import random
import time

import numpy as np

from sievemark.llm.leakage import Windows, bitmap_of, find_leaks, fold, in_bitmap, leak, seeds_of


def brute(a, b):
    return max((n for n in range(len(b) + 1) if any(b[x : x + n] in a for x in range(len(b) - n + 1))), default=0)


def naive_tiling(d, i, w):
    """Greedy string tiling as it is defined: mark the longest unmarked common run, over and over."""
    out, md, mi = [], [False] * len(d), [False] * len(i)
    while True:
        best = None
        for x in range(len(d)):
            for y in range(len(i)):
                n = 0
                while x + n < len(d) and y + n < len(i) and d[x + n] == i[y + n] and not md[x + n] and not mi[y + n]:
                    n += 1
                if n >= w and (best is None or n > best[0]):
                    best = n, x, y
        if best is None:
            return out
        n, x, y = best
        out.append(n)
        md[x : x + n] = [True] * n
        mi[y : y + n] = [True] * n


def test_longest_run_against_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        d, i, w = "".join(rng.choice("ab") for _ in range(rng.randint(0, 60))), "".join(rng.choice("ab") for _ in range(rng.randint(0, 40))), rng.choice([3, 5, 8])
        got, m = leak(Windows(d, w), Windows(i, w)), brute(d, i)
        assert bool(got) == (m >= w)
        if got:
            assert got[2] == m and m <= got[1] <= min(len(d), len(i))


def test_tiles_against_definition():
    rng = random.Random(15)
    for _ in range(120):
        w = rng.choice([3, 4])
        parts = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))) for _ in range(4)]
        d, i = "".join(rng.choice(parts) for _ in range(6)), "".join(rng.sample(parts, 4))
        got, want = leak(Windows(d, w), Windows(i, w)), naive_tiling(d, i, w)
        assert (got is None) == (not want)
        if want:
            assert got[2] == max(want) and abs(got[1] - sum(want)) <= w  # ties may be broken in another order


def test_shared_runs_share_a_seed(spark):
    rng = random.Random(16)
    for _ in range(200):
        n = rng.choice([4, 9, 30])
        run = "".join(rng.choice("甲乙丙丁a1") for _ in range(n + rng.randint(0, 5)))
        noise = lambda: "".join(rng.choice("甲乙丙丁a1") for _ in range(rng.randint(0, 40)))
        owner, seeds = seeds_of([noise() + run + noise(), noise(), noise() + run + noise()], n)
        assert set(seeds[owner == 0]) & set(seeds[owner == 2])
    assert len(seeds_of(["", "短"], 30)[0]) == 0 and len(seeds_of([], 30)[0]) == 0
    some = [rng.getrandbits(64) - 2**63 for _ in range(500)]
    bitmap = bitmap_of(spark.createDataFrame([(x,) for x in some[:250]], "seed long"), 16)
    got = in_bitmap(np.array(some, dtype=np.int64), bitmap)
    assert got[:250].all() and got[250:].sum() < 25


def test_reordered_passages_are_covered():
    rng = random.Random(6)
    a, b, c = ("".join(rng.choice("甲乙丙丁戊己庚辛") for _ in range(30)) for _ in range(3))
    found = leak(Windows(f"{c}xx。{a} yy {b}", 20), Windows(a + b + c, 20))
    assert found[0] == 3 and found[1] == found[3] == 90


def test_fold():
    chars, start = fold(["Ａb-１。", "", "É²℃​好"])
    assert "".join(map(chr, chars)) == "ab1é好" and start.tolist() == [0, 3, 3, 5]


def test_seeds_do_not_cross_texts(spark):
    item = "abcdefghijklmnopqrstuvwxyz0123456789"
    frame = lambda rows, k, t: spark.createDataFrame(rows, f"{k} int, {t} string").coalesce(1)
    assert find_leaks(frame([(1, item[:18]), (2, item[18:])], "doc_id", "text"), frame([(7, item)], "item_id", "item_text")).count() == 0
    assert find_leaks(frame([(1, item)], "doc_id", "text"), frame([(7, item[:18]), (8, item[18:])], "item_id", "item_text")).count() == 0


def test_repetitive_long_texts():
    began = time.time()
    found = leak(Windows("a" * 100_000, 30), Windows("a" * 200, 30))
    assert found[2] == 200 and time.time() - began < 60


def test_frame(spark):
    item = "把氯化钠溶于水中然后加热到沸腾并记录温度随时间的变化直到晶体析出为止再称量"
    docs = [(1, "前文。" + item + "后文"), (1, "前文。" + item + "后文"), (2, item[:29]), (3, None), (4, ""), (None, item), (5, "，".join(item[:33]) + "x" * 100), (6, item * 50)]
    d = spark.createDataFrame([(k, t, 0, "z") for k, t in docs], "doc_id long, text string, item_id int, n_tiles string")
    i = spark.createDataFrame([("9", item, "q"), ("9", item, "q"), ("8", None, "q"), ("7", "", "q"), (None, item, "q"), ("6", "short", "q")], "item_id string, item_text string, text string")
    for bits in (24, 7):  # a bitmap in which all bits are set changes nothing
        got = {(r.doc_id, r.item_id, r.longest) for r in find_leaks(d, i, bits=bits).collect()}
        assert got == {(1, "9", len(item)), (5, "9", 33), (6, "9", len(item))}
    assert find_leaks(d.limit(0), i).count() == 0 and find_leaks(d, i.limit(0)).count() == 0


def test_least_coverage_prunes_exactly():
    rng = random.Random(9)
    for _ in range(300):
        d, i = ("".join(rng.choice("abc") for _ in range(rng.randint(4, n))) for n in (80, 30))
        every = leak(Windows(d, 4), Windows(i, 4))
        assert leak(Windows(d, 4), Windows(i, 4), 0.6) == (every if every and every[1] >= 0.6 * every[3] else None)


def test_frame_against_brute_force(spark):
    """All pairs, as they are tiled one by one, over texts that share passages in other orders."""
    rng = random.Random(21)
    parts = ["".join(rng.choice("甲乙丙丁戊己庚辛壬癸") for _ in range(rng.randint(6, 25))) for _ in range(30)]
    texts = ["，".join(rng.choice(parts) for _ in range(rng.randint(1, 8))) for _ in range(80)]
    items = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(25)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    i = spark.createDataFrame(list(enumerate(items)), "item_id int, item_text string").repartition(3)
    for least in (0.0, 0.5):
        got = {(r.doc_id, r.item_id): (r.n_tiles, r.n_covered, r.longest) for r in find_leaks(d, i, min_run=16, least_coverage=least).collect()}
        want = {(a, b): leak(Windows(x, 16), Windows(y, 16), least) for a, x in enumerate(texts) for b, y in enumerate(items)}
        assert got == {k: v[:3] for k, v in want.items() if v} and len(got) > 20
