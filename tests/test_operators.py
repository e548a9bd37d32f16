import difflib
import random

import pytest

from pyspark.sql import functions as F

from sievemark.functions import text as X
from sievemark.functions.rules import Rule, rules_from, tags
from sievemark.operators import fuzzy, labels, pairs, patches, ranking, sequences
from sievemark.operators.review import decide, support
from sievemark.plans import rule_tables as R


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


def test_text_functions(spark):
    c = F.col("t")
    assert one(spark, X.normalize(c), t="  a　（b）：\n c ") == "a (b): c"
    assert one(spark, X.normalize(c), t=None) == ""
    assert one(spark, X.compact(c), t=" a b　c") == "abc"
    assert one(spark, X.clean_stem(c), t="求质量 二、非选择题 共5题") == "求质量"
    assert one(spark, X.short(c, 4), t="abcdef") == "abc…"
    assert one(spark, X.slug(c), t="（a b）") == "a_b"
    assert one(spark, X.join_tags(X.split_tags(c)), t="b、a；b,,c") == "b、a、c"
    assert one(spark, X.name_key(c), t="【录音】碳酸 钠（定稿）v2.docx") == "碳酸钠"
    assert one(spark, X.block_number(c), t="12．题") == 12 and one(spark, X.block_number(c), t="41、题") is None
    for letters, number in (("A", 1), ("Z", 26), ("AA", 27), ("AZ", 52), ("ZZ", 702), ("AAA", 703)):
        assert one(spark, X.column_number(c), t=letters) == number
        assert one(spark, X.column_letters(c), t=number) == letters
    assert one(spark, X.column_number(c), t="A1") is None
    assert one(spark, X.escape(c), t='<a&"') == "&lt;a&amp;&quot;"
    assert one(spark, X.count_of(c, "ab"), t="ababxab") == 3


def test_rules(spark):
    rules = [Rule("x", ("a.*c",)), Rule("y", ("q",), (("r", "s"),), ("t",)), Rule("x", ("z",))]
    got = lambda t: one(spark, tags(rules, F.col("t")), t=t)
    assert got("abc") == ["x"] and got("q s") == ["y"] and got("qst") == [] and got("qr z") == ["y", "x"] and got(None) == []
    df = spark.createDataFrame([(1, "n", ["k"], None, None)], "ord int, name string, keys array<string>, all_of array<array<string>>, none_of array<string>")
    assert rules_from(df) == [Rule("n", ("k",))]
    assert one(spark, tags(R.TOPICS, F.col("t")), t="用CO2 灭火")[-1] == "碳与二氧化碳"


def test_labels(spark):
    df = spark.createDataFrame([("如图是工艺流程，滤液可循环使用",), ("反应前后可循环",), ("读pH曲线",), (None,)], "stem string")
    rows = labels.with_families(df, "stem").collect()
    assert "循环物质" in rows[0].visual and rows[1].visual == [] and rows[3].visual == []
    q = labels.prepare(df, "stem").withColumn("ty", labels.question_type()).select("ty", labels.difficulty(F.col("ty")).alias("d")).collect()
    assert [tuple(r) for r in q] == [("工艺流程题", 3), ("基础题", 1), ("选择题图像题", 4), ("基础题", 1)]


def test_pairs_and_scores(spark):
    left = spark.createDataFrame([("q1", ["a", "b"]), ("q2", ["z"]), ("q3", None)], "q string, t array<string>")
    right = spark.createDataFrame([("v1", ["b", "a", "a"]), ("v2", ["b"]), ("v3", [])], "v string, t array<string>")
    got = pairs.shared_counts(pairs.tag_rows(left, "q", {"f": F.col("t")}), pairs.tag_rows(right, "v", {"f": F.col("t")}), "q", "v", ["f"])
    assert {tuple(r) for r in got.collect()} == {("q1", "v1", 2), ("q1", "v2", 1)}
    counts = {f"n_{n}": F.lit(v) for n, v in {"signature": 1, "knowledge": 5, "problem": 0, "method": 1}.items()}
    row = spark.range(1).withColumns(counts).select(*[c.alias(n) for n, c in pairs.audit_score(F.lit(True), F.lit(True), F.lit(True)).items()]).first()
    assert (row.score, row.passes, row.grade) == (66 + 10 + 20 + 8 + 4, True, "完美巩固")
    none = spark.range(1).withColumns({k: F.lit(0) for k in counts}).select(pairs.audit_score(F.lit(True), F.lit(True), F.lit(True))["score"].alias("s")).first().s
    assert none == 0


def test_packed_sets_and_keyed_pairs(spark, monkeypatch):
    """Each pair once, with its counts, whether tags have a bit or not and a key is cut or not."""
    rng = random.Random(5)
    some = lambda n: sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(0, n))})
    a, b = [[(f"{x}{i}", some(4)) for i in range(30)] for x in "qv"]
    want = {(q, v, len({*s} & {*t})) for q, s in a for v, t in b if {*s} & {*t}}
    for bits, cell in ((62, 1 << 24), (2, 20)):
        monkeypatch.setattr(pairs, "BITS", bits)
        monkeypatch.setattr(pairs, "CELL", cell)
        left, right, hot = pairs.pack_sets(spark.createDataFrame(a, "q string, f array<string>"), spark.createDataFrame(b, "v string, f array<string>"), ["f"])
        right = right.withColumn("tag", F.explode("f")).select("v", "tag", *[F.col(c).alias(f"{c}_r") for c in ("f_hot", "f_cold", "f_mask")])
        met = pairs.keyed_pairs(left.withColumn("tag", F.explode("f")), right, "q", "v", ["tag"])
        got = met.where(pairs.first_shared("f", F.col("tag"), pairs.bits_of(F.array("tag"), hot["f"])) & pairs.shares_any("f")).select("q", "v", pairs.shared_size("f")).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("name", ["audit_pairs", "topk_match"])
def test_pairs_are_not_shuffled(spark, name):
    import re

    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[question_id#\d+, video_id#\d+\]", plan)


def test_contained_names(spark, monkeypatch):
    rng = random.Random(3)
    names = ["".join(rng.choice("碳酸钠钙") for _ in range(rng.randint(1, 7))) for _ in range(60)] + ["", None, "钠", "无"]
    texts = ["".join(rng.choice("碳酸钠钙。") for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["", None, "碳"]
    q = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    v = spark.createDataFrame([(n,) for n in names], "n string")
    want = {(i, n) for i, t in enumerate(texts) for n in names if t and n and n in t}
    for block in (100, 9):
        monkeypatch.setattr(pairs, "BLOCK", block)
        got = [tuple(r) for r in pairs.contained(q, v, "id", "t", "n").collect()]
        assert set(got) == want and len(got) == len(want)


def test_name_in_question_counts(spark, tmp_path):
    """A video whose name the question has comes first, before the stand-ins of its class of topics, and below 10 points too."""
    import datetime

    import duckdb
    from tools.oracle import norm

    import __spark_entry__ as entry

    at = datetime.datetime(2026, 1, 1)
    q = [("q1", "p", 3, "用CO2 灭火：看  甲（一）讲", at), ("q2", "p", 2, "溶解度与甲乙", at), ("q3", "p", 2, "", at)]
    v = [(f"v{i}", n, at) for i, n in enumerate(["CO2 与燃烧", "CO2 与灭火", "CO2 的制取", "CO2 的检验", "灭火", "CO2 灭火：看 甲(一)讲", "溶解度", "甲乙", "", None])]
    spark.createDataFrame(q, "question_id string, paper string, score int, stem string, imported_at timestamp_ntz").write.parquet(f"{tmp_path}/exam_record.parquet")
    spark.createDataFrame(v, "video_id string, video_name string, imported_at timestamp_ntz").write.parquet(f"{tmp_path}/video_record.parquet")
    con = duckdb.connect()
    for t in ("exam_record", "video_record"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("topk_match_named", "match_verdict_named", "coverage_by_paper_named"):
        df = entry.queries()[name](spark, str(tmp_path))
        rel = con.execute(entry.oracle_sql()[name])
        assert norm([tuple(r) for r in df.collect()], df.columns) == norm(rel.fetchall(), [c[0] for c in rel.description]), name
    got = {(r.question_id, r.rnk): (r.video_id, r.score) for r in entry.queries()["topk_match_named"](spark, str(tmp_path)).collect()}
    plain = {(r.question_id, r.rnk): (r.video_id, r.score) for r in entry.queries()["topk_match"](spark, str(tmp_path)).collect()}
    assert got["q1", 1][0] == "v5" and got["q1", 1] not in plain.values() and got["q2", 1][1] == plain["q2", 1][1] + 100


def test_ranking(spark):
    df = spark.createDataFrame([("a", 5, True), ("a", 4, False), ("a", 3, True), ("a", 2, True), ("b", 1, None)], "g string, s int, ok boolean")
    got = ranking.accept(df, ["g"], [F.desc("s")], F.col("ok"), F.lit(2)).orderBy("g", F.desc("s")).collect()
    assert [r.accepted for r in got] == [True, False, True, False, False]
    keys = spark.createDataFrame([("a",), ("c",)], "g string")
    assert {(r.g, r.s) for r in ranking.with_defaults(df, keys, "g", s=F.lit(0)).where("s = 0").collect()} == {("c", 0)}
    assert ranking.running_budget(df, ["g"], [F.desc("s")], F.lit(1), 2).count() == 3
    assert one(spark, ranking.place_in(F.lit("b"), F.array(F.lit("a"), F.lit("b")))) == 1


def test_sequences(spark):
    df = spark.createDataFrame([("s", 1, None), ("s", 2, "x"), ("s", 3, " "), ("s", 4, "y")], "g string, n int, c string")
    assert [r.c for r in sequences.fill_down(df, ["g"], [F.asc("n")], ["c"]).orderBy("n").collect()] == ["", "x", "x", "y"]
    assert [r.segment for r in sequences.segments(df, ["g"], [F.asc("n")], F.col("c").isNotNull() & (F.trim("c") != "")).orderBy("n").collect()] == [0, 1, 1, 2]
    ranges = spark.createDataFrame([("s", 2, 3, "r1"), ("s", 3, 9, "r2")], "g string, low int, high int, name string")
    got = sequences.in_ranges(df, "n", ranges, "low", "high", ["g"], ["low"], 4).orderBy("n").collect()
    assert [r.name for r in got] == [None, "r1", "r1", "r2"]
    assert sequences.dense_rows(df.where("n = 3"), "g", "n").count() == 3
    many = spark.range(1003).select(((F.col("id") * 7919) % 1003).alias("id"))
    placed = sequences.batches(many, [F.asc("id")], 200).collect()
    assert all(r.batch == r.id // 200 and r.place == r.id % 200 + 1 for r in placed)


def test_patches_and_review(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (1, None)], "k int, v string")
    assert {tuple(r) for r in patches.override(df, new, ["k"], ["v"]).collect()} == {(1, "a"), (2, "c")}
    assert {tuple(r) for r in patches.upsert(df, new.where("v is not null"), ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    merged = patches.merge_sides(df, new.select("k", F.col("v").alias("w")), ["k"]).collect()
    assert {(r.k, r.in_left, r.in_right) for r in merged} == {(1, True, True), (2, True, True), (3, False, True)}
    end, why = decide([(F.lit(None).cast("boolean"), "x", "1"), (F.lit(True), "y", "2")], ("z", "3"))
    assert (one(spark, end), one(spark, why)) == ("y", "2")
    assert one(spark, support(F.lit(True), F.lit(None).cast("boolean"), F.lit(False))) == 1


def _plain_score(a, b):
    import re

    words = lambda t: set(re.findall("[A-Za-z][A-Za-z0-9]+|[一-龥]{2,}", t))
    score = difflib.SequenceMatcher(None, a, b).ratio() * 0.58 + len(words(a) & words(b)) / max(1, len(words(a) | words(b))) * 0.34
    score += 0.18 if a in b or b in a else 0
    score -= 0.12 if any(x in a and y in b for x, y in fuzzy.DIRECTIONS) else 0
    return round(max(0.0, min(score, 1.0)), 3)


def test_fuzzy_against_all_pairs(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("碳酸钠钙氧化铜铁反应流程") for _ in range(rng.randint(4, 9))) for _ in range(40)]
    files = [n[: rng.randint(3, 9)] + rng.choice(["", "上", "稿"]) for n in rng.sample(names, 20)]
    left = spark.createDataFrame([(f"v{i}", n, n) for i, n in enumerate(names)] + [("none", "", "")], "left_id string, name string, context string")
    right = spark.createDataFrame([(f"t{i}", f, "正文" + f) for i, f in enumerate(files)] + [("t99", names[0], "")], "right_id string, file string, body string")
    got = {r.left_id: r for r in fuzzy.match_names(left, right).collect()}
    assert got["none"].right_id is None and got["none"].status == "none" and len(got) == 41
    for i, n in enumerate(names):
        best = max(_plain_score(n, f) for f in files)
        if best >= 0.58:
            assert abs(got[f"v{i}"].name_score - best) < 0.0015 and got[f"v{i}"].status == "by name"


def test_fuzzy_reranks_the_best_by_name_of_all(spark):
    """More than 8 rivals by shared pairs of characters, pairs of names that share none, and names that decide nothing."""
    rng = random.Random(5)
    pick = lambda lo, hi: "".join(rng.choice("碳酸钠钙氧化铜铁反应流程上下") for _ in range(rng.randint(lo, hi)))
    names = [pick(4, 12) for _ in range(60)] + ["甲乙丙丁戊己", "碳", "上碳酸钠", "", "ab碳酸钙cd"]
    files = [pick(2, 14) for _ in range(120)] + ["甲x丙y戊z", "甲一乙二丙三丁四戊五己六", "下碳酸钠", "Ab碳酸钙", "碳碳碳碳碳碳碳碳"]
    bodies = [" ".join(rng.sample(names[:60], 3)) if rng.random() < 0.5 else "正文" for _ in files]
    left = spark.createDataFrame([(i, n, n + " " + pick(3, 5)) for i, n in enumerate(names)], "left_id int, name string, context string")
    right = spark.createDataFrame([(i, f, b) for i, (f, b) in enumerate(zip(files, bodies, strict=True))], "right_id int, file string, body string")
    got = {r.left_id: r for r in fuzzy.match_names(left, right).collect()}
    key = lambda df, c: {r[0]: r[1] for r in df.select(df.columns[0], X.name_key(F.col(c))).collect()}
    ka, kb = key(left, "name"), key(right, "file")
    both = left.crossJoin(right).select("left_id", "right_id", fuzzy.body_score(X.tokens(F.col("context")), X.tokens(F.col("name")), X.compact(F.col("body"))).alias("s"))
    body = {(r.left_id, r.right_id): r.s for r in both.collect()}
    decided = 0
    for i in ka:
        score = lambda j: _plain_score(ka[i], kb[j]) if ka[i] and kb[j] else 0.0  # noqa: B023, E731
        best = sorted(kb, key=lambda j: (-score(j), j))[:8]
        if score(best[0]) < 0.58:
            best = sorted(best, key=lambda j: (-round(score(j) * 0.7 + body[i, j] * 0.3, 6), j))  # noqa: B023
            decided += 1
        want = (best[0], score(best[0]), body[i, best[0]])
        assert (got[i].right_id, got[i].name_score, got[i].body_score) == (want if any(want[1:]) else (None, 0.0, 0.0)), (names[i], want)
    assert decided > 15
    assert got[60].name_score > 0.3


def test_name_index_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    names = ["".join(rng.choice("碳酸钠钙氧化") for _ in range(rng.randint(2, 7))) for _ in range(50)]
    left = spark.createDataFrame([(i, n, n) for i, n in enumerate(names[:15])], "left_id int, name string, context string")
    right = spark.createDataFrame([(i, n, "正文") for i, n in enumerate(names[15:] * 2)], "right_id int, file string, body string")
    whole = {tuple(r) for r in fuzzy.match_names(left, right).collect()}
    monkeypatch.setattr(fuzzy, "BLOCK", 10)
    assert {tuple(r) for r in fuzzy.match_names(left, right).collect()} == whole


def test_third_generation_names_against_all_pairs(spark):
    import re

    rng = random.Random(12)
    bits = ["溶解度", "曲线", "实验", "探究", "pH", "上", "下", "金属", "活动性", "计算", "A1"]
    name = lambda: " ".join(rng.choice(bits) + rng.choice(["", "·", "（一）"]) for _ in range(rng.randint(0, 4)))
    left = [(f"v{i:02d}", name() if i else None, rng.choice(["x", "y", None])) for i in range(60)]
    right = [(f"t{i:02d}", name() + rng.choice([".docx", "", ".v1.doc"]), rng.choice(["甲 x夹", "乙", None]), rng.choice(["", None, name() * 3, "正文 " + name()])) for i in range(40)]
    squeeze = lambda t: re.sub(r"\s+", "", t or "").translate(str.maketrans("（）：", "():"))
    words = lambda t: list(dict.fromkeys(re.findall("[A-Za-z][A-Za-z0-9]+|[一-龥]{2,}", t)))
    prefer = {"x": "x夹", "z": "没有"}
    want = {}
    for v, n, src in left:
        a, best = squeeze(n), (None, 0.0)
        for t, f, folder, body in right:
            if not body:
                continue
            b = squeeze(re.sub(r"(?<=.)\.[^.]*$", "", f))
            wa, wb = words(a), words(b)
            s = (difflib.SequenceMatcher(None, a, b).ratio() * 0.55 if a else 0.0) + len(set(wa) & set(wb)) / max(1, len(set(wa) | set(wb))) * 0.25
            s += 0.04 * min(4, sum(w in squeeze(body[:5000]) for w in wa[:8])) + (0.08 if prefer.get(src) and prefer[src] in (folder or "") else 0)
            if s > best[1] + 1e-12:
                best = t, s
        want[v] = best[0], round(best[1], 3)
    l = spark.createDataFrame([(*r, 1) for r in left], "left_id string, name string, source string, score int")
    r = spark.createDataFrame([(*x, 1) for x in right], "right_id string, file string, folder string, body string, hits int")
    got = {x.left_id: (x.right_id, x.score) for x in fuzzy.match_transcripts(l, r, prefer).collect()}
    assert {k: (v[0], pytest.approx(v[1], abs=1e-3)) for k, v in want.items()} == got
    assert fuzzy.match_transcripts(l.limit(0), r, prefer).count() == 0 and {x.right_id for x in fuzzy.match_transcripts(l, r.limit(0), prefer).collect()} == {None}


def test_third_generation_forms_no_pairs(spark, monkeypatch):
    """Every name has a word that every text says; blocks, names of 200 characters and more, and ties by folder."""
    import re

    rng = random.Random(8)
    bits = ["溶解度", "曲线", "实验", "金属", "化", "氧", "2", "3", "9"]
    name = lambda n: "".join(rng.choice(bits) for _ in range(n))
    left = [(i, f"pH{'·' * (i % 2)}{name(rng.randint(0, 6))}", rng.choice(["x", "y"])) for i in range(120)] + [(120, "甲", "x"), (121, "甲", "y"), (122, "A氧" * 120, "y")]
    right = [(i, name(rng.randint(1, 5)) + ".doc", rng.choice(["x夹", "乙"]), "正文pH" + name(3)) for i in range(100)] + [(100, "A氧金" * 80, "乙", "正"), (101, "", "x夹", "正")]
    words = lambda t: list(dict.fromkeys(re.findall("[A-Za-z][A-Za-z0-9]+|[一-龥]{2,}", t)))
    want = {}
    for v, a, source in left:
        best = (0.0, None)
        for t, f, folder, body in right:
            b, wa = f.removesuffix(".doc"), words(a)
            s = difflib.SequenceMatcher(None, a, b).ratio() * 0.55 + len(set(wa) & set(words(b))) / max(1, len(set(wa) | set(words(b)))) * 0.25
            s = s + 0.04 * min(4, sum(w in body for w in wa[:8])) + (0.08 if source == "x" and "x夹" in folder else 0.0)
            best = max(best, (s, t), key=lambda x: x[0])
        want[v] = (best[1], pytest.approx(best[0], abs=6e-4))
    kept, plain = [], fuzzy.durable
    monkeypatch.setattr(fuzzy, "durable", lambda *a: kept.append(plain(*a)) or kept[-1])
    monkeypatch.setattr(fuzzy, "PLACES", 40, raising=False)
    monkeypatch.setattr(fuzzy, "SPOKEN", 50, raising=False)
    l = spark.createDataFrame(left, "left_id int, name string, source string")
    r = spark.createDataFrame(right, "right_id int, file string, folder string, body string")
    got = {x.left_id: (x.right_id, x.score) for x in fuzzy.match_transcripts(l, r, {"x": "x夹"}).collect()}
    assert got == want
    assert max(df.count() for df in kept) <= 3 * (len(left) + len(right))
