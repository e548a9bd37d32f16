"""Queries that aggregate, merge, patch and render relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.functions import text as X
from sievemark.functions.rules import tags
from sievemark.operators import patches as U
from sievemark.plans import rule_tables as R
from sievemark.queries import Registry
from sievemark.queries import base as B
from sievemark.session import table

REG = Registry()


@REG.add(
    "module_histogram",
    f"WITH {B.Q}, x AS (SELECT unnest({B.sql_tags(R.TOPICS, 'stem', 'stem')}) AS topic FROM q) SELECT topic, count(*) AS n_questions FROM x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30",
)
def module_histogram(spark: SparkSession, d: str) -> DataFrame:
    x = B.questions(spark, d, "stem").select(F.explode(tags(R.TOPICS, F.col("stem"))).alias("topic"))
    return x.groupBy("topic").agg(F.count(F.lit(1)).alias("n_questions")).orderBy(F.desc("n_questions"), "topic").limit(30)


@REG.add(
    "workbench_summary",
    f"""WITH {B.M}, {B.Q}, a AS (SELECT paper, count(*) AS n_candidates, count(*) FILTER (final_show) AS n_final, count(DISTINCT coalesce(qnum, 0)) AS n_questions FROM m WHERE paper <> '' GROUP BY 1),
    b AS (SELECT paper, count(*) FILTER (qa_status = '人工复核') AS n_reviewed, count(*) FILTER (deleted_at IS NOT NULL) AS n_deleted FROM q WHERE paper <> '' GROUP BY 1)
    SELECT paper, coalesce(n_candidates, 0) AS n_candidates, coalesce(n_final, 0) AS n_final, coalesce(n_questions, 0) AS n_questions, coalesce(n_reviewed, 0) AS n_reviewed, coalesce(n_deleted, 0) AS n_deleted FROM a FULL JOIN b USING (paper)""",
)
def workbench_summary(spark: SparkSession, d: str) -> DataFrame:
    a = B.matches(spark, d, "paper", "qnum", "final_show").where("paper <> ''").groupBy("paper").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count_if("final_show").alias("n_final"), F.countDistinct(F.coalesce("qnum", F.lit(0))).alias("n_questions")
    )
    b = B.questions(spark, d, "paper", "qa_status", "deleted_at").where("paper <> ''").groupBy("paper").agg(
        F.count_if(F.col("qa_status") == "人工复核").alias("n_reviewed"), F.count_if(F.col("deleted_at").isNotNull()).alias("n_deleted")
    )
    both = U.merge_sides(a, b, ["paper"])
    return both.select("paper", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_candidates", "n_final", "n_questions", "n_reviewed", "n_deleted")])


@REG.add(
    "paper_detail",
    f"""WITH {B.M}, {B.Q}, a AS (SELECT paper, coalesce(qnum, 999) AS n, count(*) AS n_candidates, string_agg(video_id, ',' ORDER BY video_id) FILTER (final_show AND video_id <> '') AS shown FROM m WHERE paper <> '' GROUP BY 1, 2),
    b AS (SELECT paper, coalesce(qnum, 999) AS n, min(question_id) AS question_id FROM q WHERE paper <> '' GROUP BY 1, 2)
    SELECT paper, n, question_id, coalesce(n_candidates, 0) AS n_candidates, coalesce(shown, '') AS shown FROM a FULL JOIN b USING (paper, n)""",
)
def paper_detail(spark: SparkSession, d: str) -> DataFrame:
    number = F.coalesce("qnum", F.lit(999)).alias("n")
    shown = F.array_join(F.array_sort(F.collect_list(F.when(F.col("final_show") & (F.col("video_id") != ""), F.col("video_id")))), ",")
    a = B.matches(spark, d, "paper", "qnum", "video_id", "final_show").where("paper <> ''").groupBy("paper", number).agg(F.count(F.lit(1)).alias("n_candidates"), shown.alias("shown"))
    b = B.questions(spark, d, "paper", "qnum").where("paper <> ''").groupBy("paper", number).agg(F.min("question_id").alias("question_id"))
    return U.merge_sides(a, b, ["paper", "n"]).select("paper", "n", "question_id", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.coalesce("shown", F.lit("")).alias("shown"))


@REG.add(
    "coverage_totals",
    f"WITH {B.Q} SELECT coalesce(paper, 'all') AS paper, coalesce(question_type, 'all') AS question_type, count(*) AS n_questions, CAST(sum(score) AS BIGINT) AS points FROM (SELECT coalesce(paper, '-') AS paper, coalesce(question_type, '-') AS question_type, score FROM q) GROUP BY ROLLUP (paper, question_type)",
)
def coverage_totals(spark: SparkSession, d: str) -> DataFrame:
    q = B.questions(spark, d, "paper", "question_type", "score").fillna("-", ["paper", "question_type"])
    total = q.rollup("paper", "question_type").agg(F.count(F.lit(1)).alias("n_questions"), F.sum("score").alias("points"))
    return total.select(F.coalesce("paper", F.lit("all")).alias("paper"), F.coalesce("question_type", F.lit("all")).alias("question_type"), "n_questions", "points")


@REG.add(
    "override_merge",
    f"""WITH {B.Q}, l AS (SELECT question_id, arg_max(qa_status, imported_at) AS s FROM exam_record WHERE qa_status IS NOT NULL GROUP BY 1)
    SELECT question_id, coalesce(l.s, q.qa_status) AS qa_status, question_type FROM q LEFT JOIN l USING (question_id)""",
)
def override_merge(spark: SparkSession, d: str) -> DataFrame:
    """Each question with the state of its latest delivery that has one."""
    e = table(spark, d, "exam_record")
    last = e.where(F.col("qa_status").isNotNull() & F.col("question_id").isNotNull()).groupBy("question_id").agg(F.max_by("qa_status", "imported_at").alias("qa_status"))
    return U.override(B.questions(spark, d, "qa_status", "question_type").select("question_id", "qa_status", "question_type"), last, ["question_id"], ["qa_status"])


@REG.add(
    "patch_delete_insert",
    f"WITH {B.M}, s AS (SELECT match_id, question_id, video_id FROM m), n AS (SELECT match_id || '__NEW' AS match_id, question_id, video_id FROM s WHERE question_id LIKE '%-Q01' AND video_id <> '') "
    "SELECT * FROM s WHERE question_id IS NULL OR question_id NOT IN (SELECT question_id FROM n) UNION ALL SELECT * FROM n",
)
def patch_delete_insert(spark: SparkSession, d: str) -> DataFrame:
    s = B.matches(spark, d, "question_id", "video_id").select("match_id", "question_id", "video_id")
    new = s.where(F.col("question_id").endswith("-Q01") & (F.col("video_id") != "")).withColumn("match_id", F.concat("match_id", F.lit("__NEW")))
    return U.replace_group(s, new, ["question_id"])


@REG.add(
    "upsert_rows",
    "SELECT p_partkey, p_size + 100 AS p_size FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT p_partkey, p_size FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT p_partkey + 10000000, 1 FROM part WHERE p_partkey % 500 = 0",
)
def upsert_rows(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_size")
    new = p.where("p_partkey % 7 = 0").withColumn("p_size", F.col("p_size") + 100).unionByName(p.where("p_partkey % 500 = 0").select((F.col("p_partkey") + 10000000).alias("p_partkey"), F.lit(1).alias("p_size")))
    return U.upsert(p, new, ["p_partkey"])


@REG.add(
    "semi_join_final",
    f"WITH {B.M}, {B.V} SELECT v.video_id, v.source FROM v WHERE v.video_id IN (SELECT video_id FROM m WHERE final_show AND video_id <> '')",
)
def semi_join_final(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "match_audit").where("final_show AND video_id <> ''").select("video_id")
    return B.videos(spark, d, "source").join(used, "video_id", "left_semi").select("video_id", "source")


@REG.add(
    "union_sources",
    """SELECT kind, nation, count(*) AS n, round(sum(balance), 2) AS balance FROM (SELECT 'customer' AS kind, c_nationkey AS nation, CAST(c_acctbal AS DECIMAL(18, 2)) AS balance FROM customer
    UNION ALL SELECT 'supplier', s_nationkey, CAST(s_acctbal AS DECIMAL(18, 2)) FROM supplier) GROUP BY 1, 2""",
)
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    side = lambda t, c: table(spark, d, t).select(F.lit(t).alias("kind"), F.col(f"{c}_nationkey").alias("nation"), F.col(f"{c}_acctbal").cast("decimal(18,2)").alias("balance"))
    return side("customer", "c").unionByName(side("supplier", "s")).groupBy("kind", "nation").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("balance"), 2).alias("balance"))


_SQL_CELL = "'<tr><td>' || coalesce(question_type, '') || '</td><td>' || replace(replace(replace(replace(coalesce(stem, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</td></tr>'"


def _report(spark: SparkSession, d: str) -> DataFrame:
    """A table in mark-up per paper, with its questions in order. A paper has as many questions as a paper has."""
    cell = F.concat(F.lit("<tr><td>"), X.text(F.col("question_type")), F.lit("</td><td>"), X.escape(F.col("stem")), F.lit("</td></tr>"))
    q = B.questions(spark, d, "paper", "qnum", "stem", "question_type").where(F.col("paper").isNotNull()).withColumn("cell", cell)
    rows = F.array_sort(F.collect_list(F.struct("qnum", "question_id", "cell")))
    return q.groupBy("paper").agg(rows.alias("r")).select("paper", F.concat(F.lit("<table>"), F.array_join("r.cell", ""), F.lit("</table>")).alias("body"))


_SQL_REPORT = f"{B.Q}, rep AS (SELECT paper, '<table>' || string_agg({_SQL_CELL}, '' ORDER BY qnum NULLS FIRST, question_id) || '</table>' AS body FROM q WHERE paper IS NOT NULL GROUP BY 1)"


@REG.add("report_rows", f"WITH {_SQL_REPORT} SELECT paper, body FROM rep")
def report_rows(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d)


@REG.add(
    "doc_check_counts",
    f"WITH {_SQL_REPORT} SELECT paper, CAST((length(body) - length(replace(body, '<tr>', ''))) // 4 AS INT) AS n_rows, CAST((length(body) - length(replace(body, '<table', ''))) // 6 AS INT) AS n_tables, CAST(length(body) AS INT) AS size FROM rep",
)
def doc_check_counts(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("body")
    return _report(spark, d).select("paper", X.count_of(b, "<tr>").alias("n_rows"), X.count_of(b, "<table").alias("n_tables"), F.length(b).alias("size"))


@REG.add(
    "question_anchor",
    f"""WITH {B.Q} SELECT question_id, coalesce({B.sql_split('problem_tags')}[1], {B.sql_split('signatures')}[1], nullif(question_type, ''), '综合') AS anchor FROM
    (SELECT question_id, question_type, regexp_replace(problem_tags, '^([^、；;，,/ ]+).*$', '\\1') AS problem_tags, regexp_replace(signatures, '^([^、；;，,/ ]+).*$', '\\1') AS signatures FROM (SELECT question_id, question_type,
      regexp_replace(replace(coalesce(problem_tags, ''), chr(10), '~'), '^[、；;，,/ ]+', '') AS problem_tags, regexp_replace(replace(coalesce(signatures, ''), chr(10), '~'), '^[、；;，,/ ]+', '') AS signatures FROM q))""",
)
def question_anchor(spark: SparkSession, d: str) -> DataFrame:
    first = lambda c: F.get(X.split_tags(F.replace(F.col(c), F.lit("\n"), F.lit("~"))), F.lit(0))
    anchor = F.coalesce(first("problem_tags"), first("signatures"), F.nullif("question_type", F.lit("")), F.lit("综合"))
    return B.questions(spark, d, "problem_tags", "signatures", "question_type").select("question_id", anchor.alias("anchor"))


@REG.add(
    "reference_list",
    f"""WITH {B.M}, r AS (SELECT question_id, video_name, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, match_id) AS n, score FROM m WHERE question_id <> '' AND video_name <> '' AND score IS NOT NULL AND NOT isnan(score))
    SELECT question_id, string_agg(video_name, '；' ORDER BY n) AS names, CAST(round(max(score) * 10) AS BIGINT) AS best, CASE WHEN max(score) < 80 THEN '可参考' ELSE '命中' END AS verb FROM r WHERE n <= 3 GROUP BY 1""",
)
def reference_list(spark: SparkSession, d: str) -> DataFrame:
    """The names of the three best matches of each question, its best score in tenths, and a word for it."""
    from sievemark.operators.ranking import top_k

    m = B.matches(spark, d, "question_id", "video_name", "score").where("question_id <> '' AND video_name <> '' AND score IS NOT NULL AND NOT isnan(score)")
    three = top_k(m, ["question_id"], [F.desc("score"), F.asc("match_id")], 3, "n")
    g = three.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("n", "video_name"))).alias("r"), F.max("score").alias("s"))
    return g.select("question_id", F.array_join("r.video_name", "；").alias("names"), F.round(F.col("s") * 10).cast("bigint").alias("best"), F.when(F.col("s") < 80, "可参考").otherwise("命中").alias("verb"))


@REG.add(
    "match_images",
    f"""WITH {B.M}, {B.V}, i AS (SELECT video_id, array_to_string(regexp_extract_all(coalesce(screenshot_tokens, ''), 'img[A-Za-z0-9]+')[1:3], '；') AS images FROM v)
    SELECT match_id, coalesce(images, '') AS images FROM m LEFT JOIN i ON i.video_id = m.video_id WHERE final_show""",
)
def match_images(spark: SparkSession, d: str) -> DataFrame:
    i = B.videos(spark, d, "screenshot_tokens").select("video_id", F.array_join(F.slice(F.regexp_extract_all(X.text(F.col("screenshot_tokens")), F.lit("img[A-Za-z0-9]+"), F.lit(0)), 1, 3), "；").alias("images"))
    return B.matches(spark, d, "video_id", "final_show").where("final_show").join(i, "video_id", "left").select("match_id", F.coalesce("images", F.lit("")).alias("images"))


@REG.add(
    "relation_counts",
    "SELECT 'exam_record' AS relation, count(*) AS n_rows, count(DISTINCT question_id) AS n_records FROM exam_record UNION ALL SELECT 'video_record', count(*), count(DISTINCT video_id) FROM video_record "
    "UNION ALL SELECT 'transcript_record', count(*), count(DISTINCT transcript_id) FROM transcript_record UNION ALL SELECT 'match_audit', count(*), count(DISTINCT match_id) FROM match_audit",
)
def relation_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t, k in (("exam_record", "question_id"), ("video_record", "video_id"), ("transcript_record", "transcript_id"), ("match_audit", "match_id")):
        one = table(spark, d, t).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(k).alias("n_records")).select(F.lit(t).alias("relation"), "n_rows", "n_records")
        out = one if out is None else out.unionByName(one)
    return out


@REG.add(
    "write_back_rows",
    f"""WITH {B.M}, {B.V} SELECT v.sheet_id, CAST(v.source_row AS INT) AS source_row, v.video_id, count(m.match_id) AS n_matches, count(m.match_id) FILTER (final_show) AS n_final, CAST(round(coalesce(max(CASE WHEN isnan(score) THEN NULL ELSE score END), 0) * 10) AS BIGINT) AS best
    FROM v LEFT JOIN m ON m.video_id = v.video_id GROUP BY 1, 2, 3""",
)
def write_back_rows(spark: SparkSession, d: str) -> DataFrame:
    """Per source row what came of its video: pre-aggregated before it is joined."""
    score = F.when(~F.isnan("score"), F.col("score"))
    a = B.matches(spark, d, "video_id", "score", "final_show").groupBy("video_id").agg(F.count(F.lit(1)).alias("n_matches"), F.count_if("final_show").alias("n_final"), F.max(score).alias("s"))
    v = B.videos(spark, d, "sheet_id", "source_row").join(a, "video_id", "left")
    return v.select("sheet_id", "source_row", "video_id", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.coalesce("n_final", F.lit(0)).alias("n_final"), F.round(F.coalesce("s", F.lit(0.0)) * 10).cast("bigint").alias("best"))
