"""Queries over pairs of questions and videos: overlap, scores, grades, routing, review, quotas."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.functions import text as X
from sievemark.functions.rules import tags
from sievemark.operators import labels as L
from sievemark.operators import pairs as P
from sievemark.operators import ranking as K
from sievemark.plans import rule_tables as R
from sievemark.queries import Registry
from sievemark.queries import base as B
from sievemark.queries.texts import sql_families
from sievemark.session import durable

REG = Registry()

# --- topics and keywords (first generation) -------------------------------------------------------


def _topic_pairs(spark: SparkSession, d: str, k: int = 3, named: bool = False) -> DataFrame:
    """Candidates ``(question_id, video_id, score, reason_type)``: the ``k`` best of each question are among them.

    Scores are tenths, so that they are whole numbers. Pairs are scored by kind: rows with the same topics and the same of the
    words that both sides have are one kind, whose ``k`` least ids stand for the rest. A video that shares no word is among
    the ``k`` best by topics alone; others are found by the words. ``named`` adds 10 points if the video's name occurs in the
    question; these pairs are found one by one.
    """
    names = list(dict.fromkeys([r.name for r in R.TOPICS] + [t for _, t in R.SIGNALS]))
    assert len(names) <= P.BITS
    q = B.questions(spark, d, "stem").withColumns({"topic": P.bits_of(tags(R.TOPICS, F.col("stem")), names), "keyword": X.keywords(F.col("stem"))})
    q = q.withColumn("wanted", P.bits_of(F.array_compact(F.array(*[F.when(F.col("stem").rlike(f"(?i){p}"), F.lit(t)) for p, t in R.SIGNALS])), names)).withColumn("stem", X.normalize(F.col("stem")))
    v = B.videos(spark, d, "video_name").withColumns({"topic_v": P.bits_of(tags(R.TOPICS, F.col("video_name")), names), "keyword": X.keywords(F.col("video_name"))}).withColumn("video_name", X.normalize(F.col("video_name")))
    if not named:
        q, v = q.drop("stem"), v.drop("video_name")
    q, v = durable(q.drop("imported_at"), "topics"), durable(v.drop("imported_at"), "topics")

    def scored(df: DataFrame, more: int = 0) -> DataFrame:
        bits = lambda c: F.bit_count(c).cast("int")
        n, had = bits(F.col("topic").bitwiseAND(F.col("topic_v"))), bits(F.col("wanted").bitwiseAND(F.col("topic_v")))
        points = 100 * n + 12 * F.col("n_keyword") + 80 * had - 40 * (bits(F.col("wanted")) - had) + more
        both = df.withColumns({"n_topic": n, "score": points.cast("int")})
        return both.where(((F.col("n_topic") > 0) | (F.col("n_keyword") >= 3)) & (F.col("score") >= 100))

    said = lambda df, *key: df.select(*key, F.explode(F.array_distinct("keyword")).alias("word"))
    shared = durable(said(q).distinct().join(said(v).distinct(), "word", "left_semi"), "words")

    def kinds(df: DataFrame, key: str) -> DataFrame:
        own = said(df, key).join(shared, "word").groupBy(key).agg(F.array_sort(F.collect_set("word")).alias("words"))
        return durable(df.drop("keyword", "stem", "video_name").join(own, key, "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>"))), "kinds")

    qs, vs = kinds(q, "question_id"), kinds(v, "video_id")
    kq = durable(qs.groupBy("topic", "wanted", "words").agg(F.min("question_id").alias("kind_q")), "kinds")
    kv = durable(vs.groupBy("topic_v", "words").agg(F.min("video_id").alias("kind_v")), "kinds").withColumnRenamed("words", "words_v")
    # by topics alone
    bit = lambda c: F.explode(F.array_compact(F.array(*[F.when(F.col(c).bitwiseAND(F.lit(1 << i)) != 0, F.lit(1 << i).cast("bigint")) for i in range(len(names))])))
    both = F.col("topic").bitwiseAND(F.col("topic_v"))
    met = kq.select("topic", "wanted").distinct().withColumn("bit", bit("topic")).join(kv.select("topic_v").distinct().withColumn("bit", bit("topic_v")), "bit").where(F.col("bit") == both.bitwiseAND(F.negative(both)))
    first = K.top_k(vs.select("topic_v", "video_id"), ["topic_v"], [F.asc("video_id")], k, "at").select("topic_v", "video_id")
    order = [F.desc("score"), F.asc("video_id")]
    by_topic = K.top_k(scored(met.withColumn("n_keyword", F.lit(0))).join(first, "topic_v"), ["topic", "wanted"], order, k, "at").drop("at").join(kq, ["topic", "wanted"])
    # by words; a generator, as the filter on the score would else count the words again
    common = F.array_intersect("words", "words_v")
    met = P.keyed_pairs(kq.withColumn("word", F.explode("words")), kv.withColumn("word", F.explode("words_v")), "kind_q", "kind_v", ["word"])
    met = met.select("kind_q", "kind_v", "topic", "wanted", "topic_v", F.explode(F.when(F.col("word") == F.get(common, F.lit(0)), F.array(F.size(common)))).alias("n_keyword"))
    few = K.top_k(vs.withColumnRenamed("words", "words_v").join(kv, ["topic_v", "words_v"]).select("kind_v", "video_id"), ["kind_v"], [F.asc("video_id")], k, "at").drop("at")
    by_word = K.top_k(scored(met), ["kind_q"], [F.desc("score"), F.asc("kind_v")], k, "at").drop("at").join(few, "kind_v")
    columns = ("score", "n_topic")
    most = [F.max(c).alias(c) for c in columns]
    best = by_topic.select("kind_q", "video_id", *columns).unionByName(by_word.select("kind_q", "video_id", *columns)).groupBy("kind_q", "video_id").agg(*most)
    of_kind = K.top_k(best, ["kind_q"], order, k, "at").drop("at")
    every = qs.join(kq, ["topic", "wanted", "words"]).select("question_id", "kind_q").join(of_kind, "kind_q").select("question_id", "video_id", *columns)
    if named:
        found = P.contained(q.select("question_id", "stem"), v.select("video_name"), "question_id", "stem", "video_name")
        by_name = found.join(v.select("video_id", "video_name", "topic_v", F.col("keyword").alias("keyword_v")), "video_name").join(q.drop("stem"), "question_id")
        every = every.unionByName(scored(by_name.withColumn("n_keyword", F.size(F.array_intersect("keyword", "keyword_v"))), 100).select("question_id", "video_id", *columns))
        every = every.groupBy("question_id", "video_id").agg(*most)
    return every.select("question_id", "video_id", "score", F.when(F.col("n_topic") > 0, "核心知识点相同").otherwise("题型方法/素材相似").alias("reason_type"))


_SQL_SIGNALS = "[" + ", ".join(f"CASE WHEN regexp_matches(stem, '(?i){p}') THEN '{t}' END" for p, t in R.SIGNALS) + "]"


def _sql_words(x: str) -> str:
    stop = "[" + ", ".join(B.sql_quote(w) for w in X.STOP_WORDS) + "]"
    return f"list_filter(list_distinct(regexp_extract_all(coalesce({x}, ''), '{X.WORD}')), lambda z: NOT list_contains({stop}, z))"


def _sql_topics(named: bool = False) -> str:
    bonus = " + CASE WHEN inside THEN 100 ELSE 0 END" if named else ""
    inside = ", txt_v <> '' AND contains(txt_q, txt_v) AS inside" if named else ""
    txt = lambda x, c: f", {B.sql_normalize(c)} AS txt_{x}" if named else ""
    return f"""{B.Q}, {B.V},
qt AS (SELECT question_id, {B.sql_tags(R.TOPICS, 'stem', 'stem')} AS topic, {_sql_words('stem')} AS kw, list_filter({_SQL_SIGNALS}, lambda z: z IS NOT NULL) AS wanted{txt('q', 'stem')} FROM q),
vt AS (SELECT video_id, {B.sql_tags(R.TOPICS, 'video_name', 'video_name')} AS topic, {_sql_words('video_name')} AS kw{txt('v', 'video_name')} FROM v),
x AS (SELECT question_id, video_id, len(list_intersect(qt.topic, vt.topic)) AS nt, len(list_intersect(qt.kw, vt.kw)) AS nk, wanted, len(list_filter(wanted, lambda z: list_contains(vt.topic, z))) AS had{inside} FROM qt CROSS JOIN vt),
scored AS (SELECT question_id, video_id, CAST(100 * nt + 12 * nk + 80 * had - 40 * (len(wanted) - had){bonus} AS INT) AS score, CASE WHEN nt > 0 THEN '核心知识点相同' ELSE '题型方法/素材相似' END AS reason_type FROM x WHERE nt > 0 OR nk >= 3),
kept AS (SELECT * FROM scored WHERE score >= 100),
top3 AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, video_id) AS rnk FROM kept QUALIFY rnk <= 3)"""


_SQL_TOPICS, _SQL_NAMED = _sql_topics(), _sql_topics(named=True)


def _top3(spark: SparkSession, d: str, named: bool = False) -> DataFrame:
    return K.top_k(_topic_pairs(spark, d, named=named), ["question_id"], [F.desc("score"), F.asc("video_id")], 3)


@REG.add("topk_match", f"WITH {_SQL_TOPICS} SELECT question_id, CAST(rnk AS INT) AS rnk, video_id, score, reason_type FROM top3")
def topk_match(spark: SparkSession, d: str) -> DataFrame:
    return _top3(spark, d).select("question_id", "rnk", "video_id", "score", "reason_type")


@REG.add("topk_match_named", f"WITH {_SQL_NAMED} SELECT question_id, CAST(rnk AS INT) AS rnk, video_id, score, reason_type FROM top3")
def topk_match_named(spark: SparkSession, d: str) -> DataFrame:
    """``topk_match`` with all of the score: 10 points more for a video whose name occurs in the question."""
    return _top3(spark, d, named=True).select("question_id", "rnk", "video_id", "score", "reason_type")


_SQL_VERDICT = "SELECT question_id, CASE WHEN best IS NULL THEN '❌' WHEN best >= 180 THEN '✅' ELSE '✅?' END AS verdict FROM q LEFT JOIN (SELECT question_id, score AS best FROM top3 WHERE rnk = 1) USING (question_id)"


def _verdict(spark: SparkSession, d: str, named: bool = False) -> DataFrame:
    best = _topic_pairs(spark, d, 1, named).groupBy("question_id").agg(F.max("score").alias("score"))
    verdict = F.when(F.col("score").isNull(), "❌").when(F.col("score") >= 180, "✅").otherwise("✅?")
    return B.questions(spark, d).select("question_id").join(best, "question_id", "left").select("question_id", verdict.alias("verdict"))


@REG.add("match_verdict", f"WITH {_SQL_TOPICS} {_SQL_VERDICT}")
def match_verdict(spark: SparkSession, d: str) -> DataFrame:
    return _verdict(spark, d)


@REG.add("match_verdict_named", f"WITH {_SQL_NAMED} {_SQL_VERDICT}")
def match_verdict_named(spark: SparkSession, d: str) -> DataFrame:
    return _verdict(spark, d, named=True)


_SQL_COVERAGE = """, b AS (SELECT q.paper, q.score AS points, t.score FROM q LEFT JOIN (SELECT question_id, max(score) AS score FROM kept GROUP BY 1) t USING (question_id))
    SELECT paper, count(*) AS n_questions, count(score) AS n_hits, count(*) FILTER (score >= 180) AS n_strong, CAST(sum(points) AS BIGINT) AS points, CAST(coalesce(sum(points) FILTER (score IS NOT NULL), 0) AS BIGINT) AS points_hit FROM b GROUP BY paper"""


def _coverage(spark: SparkSession, d: str, named: bool = False) -> DataFrame:
    best = _topic_pairs(spark, d, 1, named).groupBy("question_id").agg(F.max("score").alias("best"))
    q = B.questions(spark, d, "paper", "score").join(best, "question_id", "left")
    hit = F.col("best").isNotNull()
    return q.groupBy("paper").agg(
        F.count(F.lit(1)).alias("n_questions"), F.count("best").alias("n_hits"), F.count_if(F.col("best") >= 180).alias("n_strong"),
        F.sum("score").alias("points"), F.coalesce(F.sum(F.when(hit, F.col("score"))), F.lit(0)).cast("bigint").alias("points_hit"),
    )


@REG.add("coverage_by_paper", f"WITH {_SQL_TOPICS}{_SQL_COVERAGE}")
def coverage_by_paper(spark: SparkSession, d: str) -> DataFrame:
    return _coverage(spark, d)


@REG.add("coverage_by_paper_named", f"WITH {_SQL_NAMED}{_SQL_COVERAGE}")
def coverage_by_paper_named(spark: SparkSession, d: str) -> DataFrame:
    return _coverage(spark, d, named=True)


# --- graded audit (signatures, or type with knowledge and problem tags) -----------------------------

_AUDIT_SETS = {"signature": "signatures", "knowledge": "knowledge_tags", "problem": "problem_tags", "method": "method_skeleton"}
_COMPOSITE = ("科学探究题", "计算题", "工艺流程题", "推断题")


_NOT_GIVEN = "不推荐"


@dataclass(frozen=True)
class _Audit:
    """Questions and videos with their packed sets (and the tags of two of them, by which pairs are found)."""

    q: DataFrame
    v: DataFrame
    hot: dict[str, list[str]]

    def only(self, questions: DataFrame) -> _Audit:
        """The questions of ``questions`` (``question_id``, unique), with its other columns."""
        return _Audit(self.q.join(questions, "question_id"), self.v, self.hot)

    def pairs(self, *more: str, final: bool = False) -> DataFrame:
        """All candidates with counts, score and grade, and columns ``more`` of the questions: by signature, or by type and knowledge tag
        together with problem tag. Each is formed once, at the first tag it shares, and goes on without a shuffle. ``final``: those by
        signature only, as no other is graded."""

        def keyed(df: DataFrame) -> DataFrame:
            of = lambda kind, kind_type, tags_: F.transform(tags_, lambda t: F.struct(F.lit(kind).alias("kind"), kind_type.alias("of_type"), t.alias("tag")))
            by = of("s", F.lit(""), F.col("signature"))
            if not final:
                typed = of("k", F.coalesce("question_type", F.lit("")), F.col("knowledge"))
                by = F.concat(by, F.when(F.col("question_type").isNotNull(), typed).otherwise(F.slice(typed, 1, 0)))
            return df.withColumn("key", F.explode(by)).select("*", "key.*").drop("key", "signature", "knowledge", "problem", "method")

        bit = lambda n: P.bits_of(F.array("tag"), self.hot[n])
        left, right = keyed(self.q).withColumn("bit", bit("signature") if final else F.when(F.col("kind") == "s", bit("signature")).otherwise(bit("knowledge"))), keyed(self.v)
        right = right.select("kind", "of_type", "tag", *[F.col(c).alias(c if c == "video_id" else f"{c}_r") for c in right.columns if c not in ("kind", "of_type", "tag")])
        met = P.keyed_pairs(left, right, "question_id", "video_id", ["kind", "of_type", "tag"])
        once = P.first_shared("signature", F.col("tag"), F.col("bit"))
        if not final:
            typed = ~P.shares_any("signature") & P.shares_any("problem") & P.first_shared("knowledge", F.col("tag"), F.col("bit"))
            once = F.when(F.col("kind") == "s", once).otherwise(typed)
        # a generator, as filters on the score would else be pushed below the counts, and count again for each mention
        counts = F.struct(*[P.shared_size(n).alias(f"n_{n}") for n in _AUDIT_SETS])
        kinds = ["question_type", "question_type_r", "difficulty", "difficulty_r"]
        counted = met.select("question_id", "video_id", *more, *kinds, F.explode(F.when(once, F.array(counts))).alias("n")).select("*", "n.*")
        got = P.audit_score(*_likeness("question_type", "question_type_r", "difficulty", "difficulty_r"))
        return counted.select("question_id", "video_id", *more, *[f"n_{n}" for n in _AUDIT_SETS], *[c.alias(n) for n, c in got.items()])


def _likeness(type_q: str, type_v: str, diff_q: str, diff_v: str) -> list[Column]:
    """Whether types are the same, difficulties near, and the question's type composite."""
    tests = F.col(type_q) == F.col(type_v), F.abs(F.col(diff_q) - F.col(diff_v)) <= 1, F.col(type_q).isin(*_COMPOSITE)
    return [F.coalesce(t, F.lit(False)) for t in tests]


def _audit(spark: SparkSession, d: str) -> _Audit:
    columns = [*_AUDIT_SETS.values(), "question_type", "difficulty"]
    sets = [X.split_tags(F.col(c)).alias(n) for n, c in _AUDIT_SETS.items()]
    side = lambda df, key: durable(df.select(key, "question_type", "difficulty", *sets), "tags")
    q, v, hot = P.pack_sets(side(B.questions(spark, d, *columns), "question_id"), side(B.videos(spark, d, *columns), "video_id"), list(_AUDIT_SETS))
    return _Audit(q, v, hot)


def _final_of(audit: _Audit) -> DataFrame:
    """``(question_id, best)``: the video of the final row of each question that has one, of the graded the one with the most points and the least id."""
    given = F.col("grade") != _NOT_GIVEN
    top = audit.pairs(final=True).where(given).groupBy("question_id").agg(F.max("score").alias("top"))
    return audit.only(durable(top, "top")).pairs("top", final=True).where(given & (F.col("score") == F.col("top"))).groupBy("question_id").agg(F.min("video_id").alias("best"))


def _with_final(spark: SparkSession, d: str) -> DataFrame:
    """``(question_id)`` of the questions with a final row. Signatures, types and difficulties decide for most, as no shared tag takes points away; pairs are formed for the rest."""
    audit = _audit(spark, d)
    kind = ["question_type", "difficulty", "signature"]
    of = lambda df, x: df.where(F.size("signature") > 0).select(*[F.col(c).alias(f"{c}_{x}") for c in kind]).distinct()
    one = lambda df, x: df.withColumn("tag", F.explode(f"signature_{x}"))
    counts = {"n_signature": F.size(F.array_intersect("signature_q", "signature_v")), "n_knowledge": F.lit(0), "n_problem": F.lit(0), "n_method": F.lit(0)}
    met = one(of(audit.q, "q"), "q").join(one(of(audit.v, "v"), "v"), "tag").withColumns(counts)
    grade = P.audit_score(*_likeness("question_type_q", "question_type_v", "difficulty_q", "difficulty_v"))["grade"]
    sure = met.where(grade != _NOT_GIVEN).select(*[f"{c}_q" for c in kind]).distinct().withColumn("sure", F.lit(True))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_q")) for c in kind])
    q = durable(audit.q.where(F.size("signature") > 0).join(sure, same, "left").select("question_id", "sure"), "sure")
    rest = audit.only(q.where("sure IS NULL").select("question_id")).pairs(final=True).where(F.col("grade") != _NOT_GIVEN)
    return q.where("sure").select("question_id").unionByName(rest.select("question_id").distinct())


def _sql_sets(t: str, key: str, more: str = "") -> str:
    return f"SELECT {key}, question_type, difficulty{more}, " + ", ".join(f"{B.sql_split(c)} AS {n}" for n, c in _AUDIT_SETS.items()) + f" FROM {t}"


_SQL_AUDIT = f"""{B.Q}, {B.V}, qs AS ({_sql_sets('q', 'question_id', ', paper, qnum')}), vs AS ({_sql_sets('v', 'video_id')}),
cnt AS (SELECT question_id, video_id, paper, qnum, coalesce(qs.question_type = vs.question_type, false) AS same, coalesce(abs(qs.difficulty - vs.difficulty) <= 1, false) AS near,
  coalesce(qs.question_type IN ('科学探究题', '计算题', '工艺流程题', '推断题'), false) AS composite, {', '.join(f"CAST(len(list_intersect(qs.{n}, vs.{n})) AS INT) AS n_{n}" for n in _AUDIT_SETS)} FROM qs CROSS JOIN vs),
cand AS (SELECT *, composite AND n_signature = 0 AND n_method = 0 AS barred FROM cnt WHERE n_signature > 0 OR (same AND n_knowledge > 0 AND n_problem > 0)),
raw AS (SELECT *, CASE WHEN n_signature > 0 THEN 58 + 8 * least(n_signature, 3) ELSE 38 + 8 * least(n_knowledge, 3) + 10 * least(n_problem, 2) END
  + CASE WHEN same THEN 10 ELSE 0 END + 5 * least(n_knowledge, 4) + 6 * least(n_problem, 3) + CASE WHEN n_method > 0 THEN 8 ELSE 0 END + CASE WHEN near THEN 4 ELSE 0 END AS points FROM cand),
audit AS (SELECT question_id, video_id, paper, qnum, n_signature, n_knowledge, n_problem, n_method, CAST(CASE WHEN barred THEN least(points, 49) ELSE points END AS INT) AS score, NOT barred AS passes,
  CASE WHEN NOT barred AND n_signature > 0 AND points >= 82 THEN '完美巩固' WHEN NOT barred AND n_signature > 0 AND points >= 72 THEN '进阶变式' ELSE '不推荐' END AS grade FROM raw)"""


@REG.add("audit_pairs", f"WITH {_SQL_AUDIT} SELECT question_id, video_id, n_signature, n_knowledge, n_problem, n_method, score, passes FROM audit")
def audit_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _audit(spark, d).pairs().select("question_id", "video_id", "n_signature", "n_knowledge", "n_problem", "n_method", "score", "passes")


@REG.add("audit_grade", f"WITH {_SQL_AUDIT} SELECT grade, passes, count(*) AS n_pairs, min(score) AS least, max(score) AS most FROM audit GROUP BY 1, 2")
def audit_grade(spark: SparkSession, d: str) -> DataFrame:
    return _audit(spark, d).pairs().groupBy("grade", "passes").agg(F.count(F.lit(1)).alias("n_pairs"), F.min("score").alias("least"), F.max("score").alias("most"))


def _kept(audit: _Audit) -> DataFrame:
    """Final rows: the best graded candidate of each question; graded others and those from 45 points stay as process rows.

    Which video is final is known before the pairs are formed, so they need no order and are not shuffled."""
    best = durable(audit.q.select("question_id").join(_final_of(audit), "question_id", "left"), "best")
    given = F.col("grade") != _NOT_GIVEN
    final = given & F.coalesce(F.col("video_id") == F.col("best"), F.lit(False))
    return audit.only(best).pairs("best").where(given | (F.col("score") >= 45)).select("question_id", "video_id", "score", "grade", final.alias("final_show"))


_SQL_KEPT = f"""{_SQL_AUDIT}, acc AS (SELECT *, grade <> '不推荐' AND sum(CASE WHEN grade <> '不推荐' THEN 1 ELSE 0 END) OVER (PARTITION BY question_id ORDER BY score DESC, video_id ROWS UNBOUNDED PRECEDING) <= 1 AS final_show FROM audit),
kept AS (SELECT question_id, video_id, score, grade, final_show FROM acc WHERE final_show OR grade <> '不推荐' OR score >= 45)"""


@REG.add("audit_keep", f"WITH {_SQL_KEPT} SELECT question_id, video_id, score, grade, final_show FROM kept")
def audit_keep(spark: SparkSession, d: str) -> DataFrame:
    return _kept(_audit(spark, d))


@REG.add(
    "no_match_rows",
    f"WITH {_SQL_KEPT} SELECT question_id, video_id, score, grade, final_show FROM kept UNION ALL SELECT question_id, '', 0, '不推荐', false FROM q WHERE question_id NOT IN (SELECT question_id FROM kept)",
)
def no_match_rows(spark: SparkSession, d: str) -> DataFrame:
    audit = _audit(spark, d)
    rows = _kept(audit)
    # which questions have a row: by a pair formed again, as far as a shared signature (enough for 45 points) doesn't tell
    signature = lambda df: df.select(F.explode("signature").alias("tag"))
    q = audit.q.select("question_id", F.explode("signature").alias("tag"))
    there = durable(q.join(signature(audit.v).distinct(), "tag", "left_semi").select("question_id").distinct(), "there")
    rest = durable(audit.q.select("question_id").join(there, "question_id", "left_anti"), "rest")
    found = audit.only(rest).pairs().where((F.col("grade") != _NOT_GIVEN) | (F.col("score") >= 45)).select("question_id").distinct()
    none = rest.join(found, "question_id", "left_anti").select("question_id", F.lit("").alias("video_id"), F.lit(0).alias("score"), F.lit(_NOT_GIVEN).alias("grade"), F.lit(False).alias("final_show"))
    return rows.unionByName(none)


# --- routes and additive scores -------------------------------------------------------------------


def _routes(spark: SparkSession, generation: str) -> DataFrame:
    types = sorted({t for g in R.ROUTES.values() for p in g for t in p} | {"工艺流程题", "推断题"})
    return spark.createDataFrame([*R.ROUTES[generation], *[(t, t) for t in types]], "type_q string, type_v string").distinct()


def _sql_routes(generation: str) -> str:
    types = sorted({t for g in R.ROUTES.values() for p in g for t in p} | {"工艺流程题", "推断题"})
    return "routes(type_q, type_v) AS (SELECT DISTINCT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in [*R.ROUTES[generation], *[(t, t) for t in types]]) + "))"


@REG.add(
    "routed_pairs",
    f"""WITH {B.Q}, {B.V}, {_sql_routes('v5')} SELECT q.question_type AS type_q, v.question_type AS type_v, count(*) AS n_pairs FROM q JOIN routes r ON r.type_q = q.question_type JOIN v ON v.question_type = r.type_v GROUP BY 1, 2""",
)
def routed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs each route opens. Both sides are counted by type first, so no pair is formed."""
    q = B.questions(spark, d, "question_type").groupBy(F.col("question_type").alias("type_q")).agg(F.count(F.lit(1)).alias("nq"))
    v = B.videos(spark, d, "question_type").groupBy(F.col("question_type").alias("type_v")).agg(F.count(F.lit(1)).alias("nv"))
    return _routes(spark, "v5").join(q, "type_q").join(v, "type_v").select("type_q", "type_v", (F.col("nq") * F.col("nv")).alias("n_pairs"))


def evidence_parts(videos: DataFrame) -> DataFrame:
    """The parts of the videos' summaries, which stand for their evidence: ``(video_id, p, part)`` and other columns."""
    parts = F.filter(F.split(X.text(F.col("content_summary")), "[；;。，, \n]+"), lambda x: x != "")
    return videos.select(*[c for c in videos.columns if c != "content_summary"], F.posexplode(parts).alias("p", "part"))


def _family_kinds(spark: SparkSession, d: str, generation: str, evidence: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions and videos with their ``kind`` (labels and type), and the pairs of kinds that share a tag of any family and
    lie on a route (or share a task model, from v5), with counts and score. Labels say all there is to a pair, so
    pairs are scored by kind and never formed one by one. With ``evidence`` the labels of a video's parts belong to its
    kind, and the score has the points for the best part and for two projects."""
    names = [b.family for b in P.SCORES[generation]]

    by_part = P.EVIDENCE[generation] if evidence else {}

    def labelled(df: DataFrame, stem: str, key: str) -> DataFrame:
        rows = L.with_families(df, stem).select(key, "question_type", *names)
        own = ["question_type", *names]
        if by_part and key == "video_id":
            part = L.with_families(evidence_parts(df.select("video_id", "content_summary")), "part").where(F.greatest(*[F.size(n) for n in by_part]) > 0)
            rows = rows.join(part.groupBy("video_id").agg(F.array_sort(F.collect_set(F.struct(*by_part))).alias("parts")), "video_id", "left")
            own.append("parts")
        return durable(rows.withColumn("kind", F.to_json(F.struct(*own))), "labels")

    q = labelled(B.questions(spark, d, "stem", "question_type"), "stem", "question_id")
    v = labelled(B.videos(spark, d, "content_summary", "question_type"), "content_summary", "video_id")
    qk = q.select(F.col("kind").alias("kind_q"), F.col("question_type").alias("type_q"), *names).distinct()
    vk = v.select(F.col("kind").alias("kind_v"), F.col("question_type").alias("type_v"), *names, *(["parts"] if by_part else [])).distinct()
    sets = {n: F.col(n) for n in names}
    # a pair may share tags with a part only, as a whole text can rule out what its part says
    q_sets, v_sets = ({**sets, **{f"part_{n}": c(n) for n in by_part}} for c in (F.col, lambda n: F.flatten(f"parts.{n}")))
    met = P.shared_counts(P.tag_rows(qk, "kind_q", q_sets), P.tag_rows(vk, "kind_v", v_sets), "kind_q", "kind_v", names)
    typed = met.join(qk.select("kind_q", "type_q"), "kind_q").join(vk.select("kind_v", "type_v"), "kind_v")
    open_ = typed.join(F.broadcast(_routes(spark, generation).withColumn("routed", F.lit(True))), ["type_q", "type_v"], "left")
    allowed = F.coalesce("routed", F.lit(False)) | ((F.col("n_task_model") > 0) if generation == "v5" else F.lit(False))
    same = F.coalesce(F.col("type_q") == F.col("type_v"), F.lit(False))
    scored = open_.where(allowed).withColumn("same_type", same).withColumn("score", P.family_score(generation, F.col("same_type")))
    if by_part:
        both = scored.join(qk.select("kind_q", *[F.col(n).alias(f"{n}_q") for n in by_part]), "kind_q").join(vk.select("kind_v", "parts"), "kind_v")
        best = F.array_max(F.transform("parts", lambda e: sum((p * F.size(F.array_intersect(f"{n}_q", e[n])) for n, p in by_part.items()), F.lit(0))))
        projects = F.coalesce((F.col("type_q") == P.PROJECT) & (F.col("type_v") == P.PROJECT), F.lit(False))
        scored = both.withColumn("score", F.col("score") + F.least(F.coalesce(best, F.lit(0)), F.lit(P.MOST[generation])) + F.when(projects, 30).otherwise(0)).select(*scored.columns)
    return q.select("question_id", F.col("kind").alias("kind_q")), v.select("video_id", F.col("kind").alias("kind_v")), scored


def _sql_family(generation: str) -> str:
    bonuses = P.SCORES[generation]
    points = " + ".join(f"CASE WHEN n_{b.family} > 0 THEN {b.base} + {b.step} * least(n_{b.family}, {b.most}) ELSE 0 END" for b in bonuses)
    counts = ", ".join(f"CAST(len(list_intersect(qf.{b.family}, vf.{b.family})) AS INT) AS n_{b.family}" for b in bonuses)
    anything = " OR ".join(f"n_{b.family} > 0" for b in bonuses)
    gate = "r.type_q IS NOT NULL" + (" OR n_task_model > 0" if generation == "v5" else "")
    return f"""{B.Q}, {B.V}, {sql_families('q', 'question_id', 'stem')}, {sql_families('v', 'video_id', 'content_summary')}, {_sql_routes(generation)},
    cnt AS (SELECT question_id, video_id, {counts} FROM q_f qf CROSS JOIN v_f vf),
    typed AS (SELECT cnt.*, q.question_type AS type_q, v.question_type AS type_v, coalesce(q.question_type = v.question_type, false) AS same_type FROM cnt JOIN q USING (question_id) JOIN v USING (video_id) WHERE {anything}),
    scored AS (SELECT t.*, CAST(CASE WHEN same_type THEN {P.SAME_TYPE[generation]} ELSE 0 END + {points} AS INT) AS score FROM typed t LEFT JOIN routes r ON r.type_q = t.type_q AND r.type_v = t.type_v WHERE {gate})"""


_TOP12 = "top12 AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, video_id) AS rnk FROM scored WHERE score > 0 QUALIFY rnk <= 12)"


def _top12(spark: SparkSession, d: str, evidence: bool = False, generation: str = "v5", least: int = 1) -> DataFrame:
    """The twelve best videos of each question: found per kind of question, among the twelve least ids of each kind of video."""
    q, v, kinds = _family_kinds(spark, d, generation, evidence)
    stand_ins = K.top_k(v, ["kind_v"], [F.asc("video_id")], 12, "n").drop("n")
    best = K.top_k(kinds.where(F.col("score") >= least).join(stand_ins, "kind_v"), ["kind_q"], [F.desc("score"), F.asc("video_id")], 12)
    return best.join(q, "kind_q")


@REG.add("family_score_v4", f"WITH {_sql_family('v4')}, {_TOP12} SELECT question_id, CAST(rnk AS INT) AS rnk, video_id, score FROM top12 WHERE score >= {P.LEAST['v4']}")
def family_score_v4(spark: SparkSession, d: str) -> DataFrame:
    """The twelve best videos of each question by the fourth generation, from its threshold."""
    return _top12(spark, d, generation="v4", least=P.LEAST["v4"]).select("question_id", "rnk", "video_id", "score")


@REG.add("family_score_v5", f"WITH {_sql_family('v5')}, {_TOP12} SELECT question_id, CAST(rnk AS INT) AS rnk, video_id, score FROM top12")
def family_score_v5(spark: SparkSession, d: str) -> DataFrame:
    return _top12(spark, d).select("question_id", "rnk", "video_id", "score")


# --- adjustments and white lists (over the stored matches) -----------------------------------------


@REG.add(
    "whitelist_score",
    f"""WITH {B.M}, l AS (SELECT question_id, list(DISTINCT video_id ORDER BY video_id) AS allowed FROM m WHERE question_id <> '' AND video_id <> '' AND final_show GROUP BY 1)
    SELECT match_id, CASE WHEN list_contains(allowed, video_id) THEN greatest(s, 480 - 20 * (list_position(allowed, video_id) - 1)) ELSE s END AS score
    FROM (SELECT match_id, question_id, video_id, CAST(round(score * 10) AS BIGINT) AS s FROM m WHERE score IS NOT NULL AND NOT isnan(score)) LEFT JOIN l USING (question_id)""",
)
def whitelist_score(spark: SparkSession, d: str) -> DataFrame:
    """Scores in tenths, raised for videos on the question's list of allowed ones: 480 for the first, 20 less for each next."""
    m = B.matches(spark, d, "question_id", "video_id", "score", "final_show")
    full = (F.col("question_id") != "") & (F.col("video_id") != "")
    ok = m.where(F.col("score").isNotNull() & ~F.isnan("score")).withColumn("s", F.round(F.col("score") * 10).cast("bigint"))
    placed = K.place_listed(ok, m.where(full & F.col("final_show")), "question_id", "video_id")
    return placed.select("match_id", F.when(F.col("place").isNotNull(), F.greatest("s", (480 - 20 * F.col("place")).cast("bigint"))).otherwise(F.col("s")).alias("score"))


@REG.add("transcript_two_stage")
def transcript_two_stage(spark: SparkSession, d: str) -> DataFrame:
    """The transcript that fits each video best, by file name and, where that does not decide, by its text."""
    from sievemark.operators.fuzzy import match_names

    v = B.videos(spark, d, "video_name", "hierarchy", "content_summary", "signatures")
    context = F.concat_ws(" ", *[X.text(F.col(c)) for c in ("video_name", "hierarchy", "content_summary", "signatures")])
    left = v.select(F.col("video_id").alias("left_id"), F.col("video_name").alias("name"), context.alias("context"))
    t = B.transcripts(spark, d, "file_name", "text").select(F.col("transcript_id").alias("right_id"), F.col("file_name").alias("file"), F.col("text").alias("body"))
    return match_names(left, t).select(F.col("left_id").alias("video_id"), F.col("right_id").alias("transcript_id"), "name_score", "body_score", "status")


@REG.add("transcript_name_match")
def transcript_name_match(spark: SparkSession, d: str) -> DataFrame:
    """The transcript that fits each video best by the third generation: name, tokens said in it, preferred folder."""
    from sievemark.operators.fuzzy import FOLDERS, match_transcripts

    v = B.videos(spark, d, "video_name", "source").select(F.col("video_id").alias("left_id"), F.col("video_name").alias("name"), "source")
    t = B.transcripts(spark, d, "file_name", "source_folder", "text").select(F.col("transcript_id").alias("right_id"), F.col("file_name").alias("file"), F.col("source_folder").alias("folder"), F.col("text").alias("body"))
    got = match_transcripts(v, t, FOLDERS | {"专题库": "银豚", "实验库": "素禾"})
    return got.select(F.col("left_id").alias("video_id"), F.col("right_id").alias("transcript_id"), "score")
