"""Queries over ordered rows: fill down, segments, ranges, neighbours, numbering, budgets, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.operators import ranking as K
from sievemark.operators import sequences as S
from sievemark.queries import Registry
from sievemark.queries import base as B
from sievemark.session import table

REG = Registry()


@REG.add(
    "fill_down",
    "SELECT event_id, coalesce(last_value(CASE WHEN event_id % 3 <> 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), '') AS event_type FROM events",
)
def fill_down(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("event_type", F.when(F.col("event_id") % 3 != 0, F.col("event_type")))
    return S.fill_down(e, ["user_id"], [F.asc("ts"), F.asc("event_id")], ["event_type"]).select("event_id", "event_type")


@REG.add(
    "segment_blocks",
    """WITH s AS (SELECT *, sum(CAST(event_type = 'signup' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM events)
    SELECT user_id, CAST(segment AS INT) AS segment, count(*) AS n_rows, string_agg(event_type, '>' ORDER BY ts, event_id) AS kinds FROM s GROUP BY 1, 2""",
)
def segment_blocks(spark: SparkSession, d: str) -> DataFrame:
    s = S.segments(table(spark, d, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")], F.col("event_type") == "signup")
    parts = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return s.groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("n_rows"), parts.alias("p")).select("user_id", "segment", "n_rows", F.array_join("p.event_type", ">").alias("kinds"))


@REG.add("first_occurrence", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL) WHERE n = 1")
def first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each text: by hash first, so that texts are not sorted."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.groupBy(F.xxhash64("text"), F.xxhash64(F.lit("other"), "text")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@REG.add(
    "next_position",
    "SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_event_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_event_type FROM events",
)
def next_position(spark: SparkSession, d: str) -> DataFrame:
    return S.following(table(spark, d, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")], ["event_id", "event_type"]).select("event_id", "next_event_id", "next_event_type")


@REG.add(
    "group_range_join",
    f"""WITH {B.Q}, g AS (SELECT paper, qnum AS low, qnum + 2 AS high, question_id AS name FROM q WHERE qnum % 4 = 0)
    SELECT q.question_id, arg_min(g.name, (g.low, g.name)) AS topic_group FROM q LEFT JOIN g ON g.paper = q.paper AND q.qnum BETWEEN g.low AND g.high GROUP BY 1""",
)
def group_range_join(spark: SparkSession, d: str) -> DataFrame:
    q = B.questions(spark, d, "paper", "qnum")
    g = q.where(F.col("qnum") % 4 == 0).select("paper", F.col("qnum").alias("low"), (F.col("qnum") + 2).alias("high"), F.col("question_id").alias("topic_group"))
    return S.in_ranges(q.select("question_id", "paper", "qnum"), "qnum", g, "low", "high", ["paper"], ["low", "topic_group"], 8).select("question_id", "topic_group")


@REG.add(
    "dense_rows",
    f"""WITH {B.V}, r AS (SELECT sheet_id, source_row, min(video_id) AS video_id FROM v GROUP BY 1, 2), m AS (SELECT sheet_id, max(source_row) AS top FROM r GROUP BY 1),
    e AS (SELECT sheet_id, unnest(range(1, top + 1)) AS source_row FROM m) SELECT e.sheet_id, CAST(e.source_row AS INT) AS source_row, coalesce(r.video_id, '') AS video_id FROM e LEFT JOIN r ON r.sheet_id = e.sheet_id AND r.source_row = e.source_row""",
)
def dense_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = B.videos(spark, d, "sheet_id", "source_row").groupBy("sheet_id", "source_row").agg(F.min("video_id").alias("video_id"))
    return S.dense_rows(rows, "sheet_id", "source_row").select("sheet_id", "source_row", F.coalesce("video_id", F.lit("")).alias("video_id"))


_EV = "ev AS (SELECT l_orderkey AS o, l_linenumber AS k, l_partkey AS p, CAST(round(l_quantity) AS INT) * 10 + CASE l_returnflag WHEN 'R' THEN 14 WHEN 'A' THEN 6 ELSE 0 END AS pts FROM lineitem)"


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "R", 14).when(F.col("l_returnflag") == "A", 6).otherwise(0)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("p"), (F.round("l_quantity").cast("int") * 10 + flag).alias("pts"))


@REG.add(
    "best_evidence",
    f"WITH {_EV}, r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY pts DESC, k, p) AS n FROM ev) SELECT o_orderkey, p AS best_part, coalesce(least(pts, 250), 0) AS points FROM orders LEFT JOIN r ON r.o = o_orderkey AND n = 1",
)
def best_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The strongest evidence row of each parent, by a combined aggregate: no rows are sorted."""
    best = _evidence(spark, d).groupBy("o").agg(F.min(F.struct((-F.col("pts")).alias("neg"), "k", "p")).alias("b"))
    o = table(spark, d, "orders").select("o_orderkey").join(best, F.col("o") == F.col("o_orderkey"), "left")
    return o.select("o_orderkey", F.col("b.p").alias("best_part"), F.coalesce(F.least(-F.col("b.neg"), F.lit(250)), F.lit(0)).alias("points"))


@REG.add(
    "evidence_numbering",
    f"WITH {_EV} SELECT o, k, p, printf('IMG%02d', row_number() OVER (PARTITION BY o ORDER BY k, p, pts)) AS image_id FROM ev",
)
def evidence_numbering(spark: SparkSession, d: str) -> DataFrame:
    ranked = K.numbered(_evidence(spark, d), ["o"], [F.asc("k"), F.asc("p"), F.asc("pts")], "n")
    return ranked.select("o", "k", "p", F.format_string("IMG%02d", F.col("n")).alias("image_id"))


@REG.add(
    "image_budget",
    f"""WITH {_EV}, g AS (SELECT o, p, count(*) AS n, min(k) AS k FROM ev GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY o ORDER BY k, p ROWS UNBOUNDED PRECEDING) AS used FROM g)
    SELECT o, p, n FROM r WHERE used <= 4""",
)
def image_budget(spark: SparkSession, d: str) -> DataFrame:
    g = _evidence(spark, d).groupBy("o", "p").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k"))
    return K.running_budget(g, ["o"], [F.asc("k"), F.asc("p")], F.col("n"), 4).select("o", "p", "n")


@REG.add(
    "positional_zip",
    f"WITH {B.V}, s AS (SELECT video_id, regexp_extract_all(coalesce(screenshot_refs, ''), '[A-Z]+:[^；;、，,\\s]+') AS a, regexp_extract_all(coalesce(screenshot_tokens, ''), 'img[A-Za-z0-9]+') AS b FROM v) "
    "SELECT video_id, CAST(i AS INT) AS pos, a[i] AS ref, b[i] AS token FROM s, unnest(range(1, greatest(len(a), len(b)) + 1)) AS u(i)",
)
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c, p: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), F.lit(0))
    z = F.arrays_zip(text("screenshot_refs", r"[A-Z]+:[^；;、，,\s]+").alias("ref"), text("screenshot_tokens", "img[A-Za-z0-9]+").alias("token"))
    v = B.videos(spark, d, "screenshot_refs", "screenshot_tokens").select("video_id", F.posexplode(z).alias("p", "z"))
    return v.select("video_id", (F.col("p") + 1).alias("pos"), F.col("z.ref").alias("ref"), F.col("z.token").alias("token"))


@REG.add(
    "display_order",
    f"""WITH {B.M}, l AS (SELECT question_id, list(DISTINCT video_id ORDER BY video_id) AS allowed FROM m WHERE question_id <> '' AND video_id <> '' AND final_show GROUP BY 1),
    p AS (SELECT match_id, m.question_id, score, CASE WHEN list_contains(allowed, m.video_id) THEN list_position(allowed, m.video_id) - 1 ELSE 950 END AS place FROM m LEFT JOIN l ON l.question_id = m.question_id
      WHERE m.question_id <> '' AND video_id <> '' AND score IS NOT NULL AND NOT isnan(score))
    SELECT match_id, CAST(place AS INT) AS place, CAST(row_number() OVER (PARTITION BY question_id ORDER BY place, score DESC, match_id) AS INT) AS shown_at FROM p""",
)
def display_order(spark: SparkSession, d: str) -> DataFrame:
    m = B.matches(spark, d, "question_id", "video_id", "score", "final_show").where((F.col("question_id") != "") & (F.col("video_id") != ""))
    p = K.place_listed(m.where(F.col("score").isNotNull() & ~F.isnan("score")), m.where("final_show"), "question_id", "video_id").withColumn("place", F.coalesce("place", F.lit(950)))
    placed = S.numbered_wide(p, ["question_id"], [F.asc("place"), F.desc("score"), F.asc("match_id")], "shown_at")
    return placed.select("match_id", "place", F.col("shown_at").cast("int").alias("shown_at"))


@REG.add(
    "group_dedup",
    f"WITH {B.M} SELECT paper, video_id, match_id FROM (SELECT paper, video_id, match_id, row_number() OVER (PARTITION BY paper, video_id ORDER BY qnum, match_id) AS n FROM m WHERE video_id <> '' AND paper IS NOT NULL) WHERE n = 1",
)
def group_dedup(spark: SparkSession, d: str) -> DataFrame:
    m = B.matches(spark, d, "paper", "qnum", "video_id").where((F.col("video_id") != "") & F.col("paper").isNotNull())
    return m.groupBy("paper", "video_id").agg(F.min(F.struct("qnum", "match_id")).alias("f")).select("paper", "video_id", F.col("f.match_id").alias("match_id"))


@REG.add(
    "batch_payload",
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders)
    SELECT CAST(n // 200 AS INT) AS batch, count(*) AS n_rows, string_agg(CAST(o_orderkey AS VARCHAR) || ',' || o_orderstatus, ';' ORDER BY o_orderkey) AS payload FROM r GROUP BY 1""",
)
def batch_payload(spark: SparkSession, d: str) -> DataFrame:
    o = S.batches(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), [F.asc("o_orderkey")], 200)
    rows = F.array_sort(F.collect_list(F.struct("place", F.concat_ws(",", "o_orderkey", "o_orderstatus").alias("row"))))
    return o.groupBy("batch").agg(F.count(F.lit(1)).alias("n_rows"), rows.alias("r")).select("batch", "n_rows", F.array_join("r.row", ";").alias("payload"))
