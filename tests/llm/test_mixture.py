import pytest
from pyspark.sql import functions as F

from sievemark.llm.mixture import Target, count_tokens, mix, mixture_report, route


def test_route_meets_shares():
    size, flow = route({("a",): 1000, ("b",): 300, ("a", "b"): 200}, [Target("a", 0.5, 1), Target("b", 0.5, 2), Target("c", 0.2, 9)])
    a = sum(x for (p, s), x in flow.items() if s == "a")
    b = sum(x for (p, s), x in flow.items() if s == "b")
    assert a == pytest.approx(b) and a + b == pytest.approx(size)
    # each text of both sources may be used twice in all: a has 1000 and what b leaves it, b 600 and what is left
    assert size == pytest.approx(2000)


def test_route_prefers_fresh_text():
    _, flow = route({("a",): 100, ("a", "b"): 100}, [Target("a", 0.5, 4), Target("b", 0.5, 4)], total=200.0)
    assert flow[("a",), "a"] == pytest.approx(100) and flow[("a", "b"), "b"] == pytest.approx(100)


def test_route_of_nothing():
    assert route({}, [Target("a", 1.0, 1)]) == (0.0, {}) and route({("x",): 5}, []) == (0.0, {})


@pytest.fixture
def docs(spark):
    rows = [(i, "词语甲乙丙丁" * (1 + i % 7) + str(i), "big" if i % 3 == 0 else "mid" if i % 3 == 1 else "small" if i % 9 == 2 else "other") for i in range(3000)]
    rows += [(9001, None, "big"), (9002, "", "mid"), (9003, "x", None), (None, "y", "big"), (9004, rows[0][1], "mid"), (9005, rows[0][1], "big")]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, n int, pattern int")


TARGETS = [("big", 0.5, 1), ("mid", 0.3, 1), ("small", 0.2, 3), ("none", 0.1, 5), ("big", 0.1, 1), (None, 0.3, 2), ("zero", None, None)]


def test_shares_and_caps(spark, docs):
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    m = mix(docs, t, slice_texts=100).cache()
    r = {x.source: x for x in mixture_report(m, t).collect()}
    assert r["none"].n_tokens == 0 and r["zero"].n_tokens == 0
    for s, want in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert r[s].actual_share == pytest.approx(want, abs=0.003)
    assert r["big"].most_uses == 1 and 1 <= r["small"].most_uses <= 3
    assert m.groupBy("doc_id", "source").count().where("count > 1").count() == 0
    # the text in two sources is used once a source at most, and under its least key there
    assert {x.doc_id for x in m.where("doc_id in (0, 9004, 9005)").collect()} <= {0, 9004}
    again = mix(docs.repartition(7), t, slice_texts=20)
    assert {tuple(x) for x in again.collect()} == {tuple(x) for x in m.collect()}
    assert {tuple(x) for x in mix(docs, t, seed=5).collect()} != {tuple(x) for x in m.collect()}


def test_scarce_with_total(spark, docs):
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2)], "source string, target_share double, max_repeats int")
    tokens = docs.where("source = 'small'").select(F.sum(count_tokens()(F.col("text"))).alias("n")).first().n
    m = mix(docs, t, total=float(tokens * 10))
    assert m.where("source = 'small'").agg(F.min("n_uses"), F.max("n_uses")).first() == (2, 2)


def test_empty(spark, docs):
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    assert mix(docs.limit(0), t).count() == 0 and mix(docs, t.limit(0)).count() == 0


def test_tokens_count_whole_texts(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,), ("<|endoftext|>",), ("水" * 100_000,)], "t string")
    got = [r.n for r in df.select(count_tokens()(F.col("t")).alias("n")).collect()]
    assert got[0] == 2 and got[1:3] == [0, 0] and got[3] > 1 and got[4] >= 50_000


def test_copies_and_patterns(spark, docs):
    rows = [(i, "同一段文字", "a") for i in range(50)] + [(100 + i, f"另一段文字{i}", "b") for i in range(50)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    assert mix(d, t).where("source = 'a'").count() == 1 and mix(d, t, merge_copies=False).where("source = 'a'").count() > 20
    with pytest.raises(ValueError, match="patterns"):
        mix(d, t, max_patterns=1)
