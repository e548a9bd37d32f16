"""Queries on visual anchors, label edits, evidence of pairs, and the analysis row of each question."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.functions import text as X
from sievemark.functions.rules import cascade, has_any, tags
from sievemark.operators import labels as L
from sievemark.operators import pairs as P
from sievemark.operators import ranking as K
from sievemark.operators.gated import edit_labels
from sievemark.plans import rule_tables as R
from sievemark.queries import Registry
from sievemark.queries import base as B
from sievemark.queries.matching import _sql_family, _top12, evidence_parts
from sievemark.queries.texts import sql_families
from sievemark.session import durable

REG = Registry()


def _anchored(df: DataFrame, text: str) -> DataFrame:
    return L.prepare(df, text).withColumn("anchors", tags(R.ANCHORS, F.col("_raw"), F.col("_packed")))


def _sql_anchors(source: str, key: str, text: str, more: str = "") -> str:
    return f"{source}_a AS (SELECT {key}{more}, {B.sql_tags(R.ANCHORS, 'r', 'p')} AS anchors FROM (SELECT *, coalesce({text}, '') AS r, {B.sql_compact(text)} AS p FROM {source}))"


@REG.add("visual_anchors", f"WITH {B.Q}, {_sql_anchors('q', 'question_id', 'stem')} SELECT question_id, array_to_string(anchors, '、') AS anchors FROM q_a")
def visual_anchors(spark: SparkSession, d: str) -> DataFrame:
    return _anchored(B.questions(spark, d, "stem"), "stem").select("question_id", X.join_tags(F.col("anchors")).alias("anchors"))


@REG.add(
    "composite_questions",
    f"WITH {B.Q}, {_sql_anchors('q', 'question_id', 'stem', ', question_type, signatures')} SELECT question_id, len({B.sql_split('signatures')}) >= 2 OR (coalesce(question_type, '') = '综合应用题' AND len(anchors) >= 2) AS composite FROM q_a",
)
def composite_questions(spark: SparkSession, d: str) -> DataFrame:
    q = _anchored(B.questions(spark, d, "stem", "question_type", "signatures"), "stem")
    many = (F.size(X.split_tags(F.col("signatures"))) >= 2) | ((X.text(F.col("question_type")) == "综合应用题") & (F.size("anchors") >= 2))
    return q.select("question_id", many.alias("composite"))


@REG.add(
    "video_types",
    f"WITH {B.V} SELECT video_id, CASE " + " ".join(f"WHEN {B.sql_has_any('p', 'p', k)} THEN '{t}'" for t, k in R.NAME_TYPES) + f" ELSE coalesce(nullif(question_type, ''), '基础题') END AS video_type FROM (SELECT *, {B.sql_compact("concat_ws(' ', coalesce(video_name, ''), coalesce(hierarchy, ''))")} AS p FROM v)",
)
def video_types(spark: SparkSession, d: str) -> DataFrame:
    """The type of a video by its name and place, else the type it is stored with."""
    v = B.videos(spark, d, "video_name", "hierarchy", "question_type").withColumn("p", X.compact(F.concat_ws(" ", X.text(F.col("video_name")), X.text(F.col("hierarchy")))))
    kind = cascade([(has_any(F.col("p"), k, F.col("p")), t) for t, k in R.NAME_TYPES], F.coalesce(F.nullif("question_type", F.lit("")), F.lit("基础题")))
    return v.select("video_id", kind.alias("video_type"))


def _sql_name_edits() -> str:
    """A relation for each edit, ending in ``x<last>``."""
    out, of = [], "x0"
    for ord_, word, family, op, tags_ in R.NAME_EDITS:
        new = B.sql_quote(tags_[0]) if family == "primary_type" else f"list_concat({family}, list_filter([{', '.join(map(B.sql_quote, tags_))}], lambda z: NOT list_contains({family}, z)))"
        out.append(f"x{ord_} AS (SELECT * REPLACE (CASE WHEN contains(coalesce(video_name, ''), {B.sql_quote(word)}) THEN {new} ELSE {family} END AS {family}) FROM {of})")
        of = f"x{ord_}"
    return ", ".join(out)


@REG.add(
    "label_edits",
    f"""WITH {B.V}, {sql_families('v', 'video_id', 'content_summary')}, x0 AS (SELECT video_id, video_name, coalesce(question_type, '') AS primary_type, visual, background, task, task_model, method FROM v JOIN v_f USING (video_id)), {_sql_name_edits()}
    SELECT video_id, primary_type, {", ".join(f"array_to_string({f}, '、') AS {f}" for f in ("visual", "background", "task", "task_model", "method"))} FROM x{R.NAME_EDITS[-1][0]}""",
)
def label_edits(spark: SparkSession, d: str) -> DataFrame:
    """Labels changed by words in the video's name, from a table of edits."""
    v = B.videos(spark, d, "video_name", "content_summary", "question_type").withColumn("primary_type", X.text(F.col("question_type")))
    rows = [(i, w, None, f, op, t) for i, w, f, op, t in R.NAME_EDITS]
    edits = spark.createDataFrame(rows, "ord int, video_name_like string, only array<string>, family string, op string, tags array<string>")
    v = edit_labels(L.with_families(v, "content_summary"), edits, ["video_name"])
    return v.select("video_id", "primary_type", *[X.join_tags(F.col(f)).alias(f) for f in ("visual", "background", "task", "task_model", "method")])


_SCIENCE, _BASIC, _APPLIED = "科学探究题", "基础题", "综合应用题"
#: What the third generation wants of a pair that is shown, and of the best part of its evidence.
SHOWN_FROM, PART_FROM = 110, 24


def _sides(spark: SparkSession, d: str, evidence: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Questions, videos and, if ``evidence`` is wanted, the parts of it, with anchors; a part also has the anchors that it or the name says."""
    columns = ("question_type", "signatures", "knowledge_tags")
    sets = {"sig": X.split_tags(F.col("signatures")), "kn": X.split_tags(F.col("knowledge_tags"))}
    q = _anchored(B.questions(spark, d, "stem", *columns), "stem").select("question_id", F.col("question_type").alias("type"), "anchors", *[c.alias(n) for n, c in sets.items()])
    q = q.withColumn("composite", (F.size("sig") >= 2) | ((X.text(F.col("type")) == _APPLIED) & (F.size("anchors") >= 2)))
    v = _anchored(B.videos(spark, d, "content_summary", *columns), "content_summary").select("video_id", F.col("question_type").alias("type"), "anchors", *[c.alias(n) for n, c in sets.items()])
    if not evidence:
        return durable(q, "questions"), durable(v, "videos"), None
    part = _anchored(evidence_parts(B.videos(spark, d, "video_name", "content_summary")), "part").withColumn("_said", X.compact(F.concat("part", X.text(F.col("video_name")))))
    names = F.array_compact(F.array(*[F.when(F.col("_said").contains(X.compact(F.lit(r.name))), F.lit(r.name)) for r in R.ANCHORS]))
    parts = part.select("video_id", F.struct("anchors", names.alias("said")).alias("part")).distinct()
    return durable(q, "questions"), durable(v, "videos"), durable(parts, "parts")


def _routed_v3(q_type: Column, v_type: Column, composite: Column) -> Column:
    other = ((q_type == _SCIENCE) & (v_type == "基本实验题")) | (q_type.isin(_BASIC, _APPLIED) & (v_type == _APPLIED))
    free = ~q_type.isin(_SCIENCE, "计算题", "工艺流程题", "推断题", "科普阅读题")
    return F.coalesce((q_type == v_type) | other | (composite & free & (v_type == _APPLIED)), F.lit(False))


#: Videos of a type, and questions that may go to it, that one task takes at once.
CELL_VIDEOS, CELL_QUESTIONS = 30_000, 30_000


def _postings(cells: pd.Series) -> dict[str, np.ndarray]:
    """The places of the rows that have each tag."""
    out: dict[str, list[int]] = {}
    for i, tags_ in enumerate(cells):
        for t in tags_:
            out.setdefault(t, []).append(i)
    return {t: np.array(at, dtype=np.int64) for t, at in out.items()}


def _best_of_cell(q: pd.DataFrame, v: pd.DataFrame, best: int) -> pd.DataFrame:
    """The ``best`` videos of each question of a cell from the threshold, by score and then id: ``(question_id, video_id, score, points, composite)``.

    Type, anchors and evidence score a kind of question against all videos at once. A video that can't come among the best even with
    all the points for knowledge is only looked at if it shares a signature.
    """
    names = ["question_id", "video_id", "score", "points", "composite"]
    if q.empty or v.empty:
        return pd.DataFrame(columns=names)
    v = v.sort_values("video_id", key=lambda c: c.map(lambda x: x.encode()), kind="stable").reset_index(drop=True)
    kind_of, kinds = pd.factorize(v["kind"])
    labels = [json.loads(k) for k in kinds]
    sig_at, kn_at, none = _postings(v["sig"]), _postings(v["kn"]), np.zeros(0, dtype=np.int64)
    ids, out = v["video_id"].to_numpy(), []
    for (q_type, anchors), rows in q.groupby(["type", "anchors"], sort=False, dropna=False):
        mine = set(json.loads(anchors))
        shared = np.array([len(mine.intersection(k["anchors"])) for k in labels])
        points = np.array([max([12 * len(mine.intersection(p["anchors"])) + 3 * len(mine.intersection(p["said"])) for p in k["parts"]], default=0) for k in labels])
        of_kind = np.where(shared > 0, 22 + 4 * np.minimum(shared, 4), 0) + np.minimum(points, P.MOST["v3"]) + (24 if q_type == v["type"].iat[0] else 0)
        base = of_kind[kind_of]
        sure = np.partition(base, len(base) - best)[len(base) - best] if len(base) >= best else 0
        near = np.flatnonzero(base + 12 >= max(sure, P.LEAST["v3"]))
        for question, composite, sig, kn in zip(rows["question_id"], rows["composite"], rows["sig"], rows["kn"], strict=True):
            by_sig = np.concatenate([none, *[sig_at[t] for t in sig if t in sig_at]])
            by_kn = np.concatenate([none, *[kn_at[t] for t in kn if t in kn_at]])
            n_sig, n_kn = np.bincount(by_sig, minlength=len(v)) if len(by_sig) else None, np.bincount(by_kn, minlength=len(v))
            at = np.union1d(near, by_sig) if len(by_sig) else near
            score = base[at] + 4 * np.minimum(n_kn[at], 3)
            if n_sig is not None:
                score += np.where(n_sig[at] > 0, 36 + 6 * np.minimum(n_sig[at], 2), 0)
            least = max(P.LEAST["v3"], np.partition(score, len(score) - best)[len(score) - best] if len(score) > best else 0)
            some = np.flatnonzero(score >= least)
            some = some[np.argsort(-score[some], kind="stable")][:best]
            if len(some):
                out.append((np.full(len(some), question, dtype=object), ids[at[some]], score[some], points[kind_of[at[some]]], np.full(len(some), composite)))
    return pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, zip(*out, strict=True), strict=True)}) if out else pd.DataFrame(columns=names)


def best_v3(spark: SparkSession, d: str, evidence: bool, best: int = 12) -> DataFrame:
    """``(question_id, video_id, score, points, composite, rnk)``: the ``best`` videos of each question from 76 points.

    Questions meet the videos of each type on their route in cells, which only hold rows; pairs are scored within a task and only the
    best of each question leave it.
    """
    q, v, parts = _sides(spark, d, evidence)
    ways = F.array_distinct(F.array(F.col("type"), F.when(F.col("type") == _SCIENCE, "基本实验题").otherwise(F.col("type")), F.lit(_APPLIED)))
    q = q.withColumn("way", F.explode(ways)).where(_routed_v3(F.col("type"), F.col("way"), F.col("composite"))).withColumn("anchors", F.to_json("anchors"))
    sets = F.array().cast("array<struct<anchors:array<string>,said:array<string>>>")
    if evidence:
        v = v.join(parts.groupBy("video_id").agg(F.array_sort(F.collect_set("part")).alias("parts")), "video_id", "left")
        sets = F.coalesce("parts", sets)
    v = v.where("type IS NOT NULL").select("video_id", "type", F.to_json(F.struct("anchors", sets.alias("parts"))).alias("kind"), "sig", "kn", F.col("type").alias("way"))
    cells = lambda df, n, size: df.groupBy("way").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(n))
    grid = cells(q, "n_q", CELL_QUESTIONS).join(cells(v, "n_v", CELL_VIDEOS), "way")

    def cut(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        cell = F.pmod(F.xxhash64(key), F.col(f"n_{own}").cast("bigint")).cast("int").alias(own)
        return df.join(grid, "way").select(*df.columns, cell, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)).alias(other))

    found = cut(q, "question_id", "q", "v").groupBy("way", "q", "v").cogroup(cut(v, "video_id", "v", "q").groupBy("way", "q", "v"))
    few = found.applyInPandas(lambda a, b: _best_of_cell(a, b, best), "question_id string, video_id string, score int, points int, composite boolean")
    return K.top_k(few, ["question_id"], [F.desc("score"), F.asc("video_id")], best).select("question_id", "video_id", "score", "points", "composite", "rnk")


_SQL_V3 = f"""{B.Q}, {B.V}, {_sql_anchors('q', 'question_id', 'stem', ', question_type, signatures, knowledge_tags')}, {_sql_anchors('v', 'video_id', 'content_summary', ', question_type, signatures, knowledge_tags')},
    qs AS (SELECT question_id, question_type, anchors, {B.sql_split('signatures')} AS s, {B.sql_split('knowledge_tags')} AS k, len({B.sql_split('signatures')}) >= 2 OR (coalesce(question_type, '') = '综合应用题' AND len(anchors) >= 2) AS composite FROM q_a), vs AS (SELECT video_id, question_type, anchors, {B.sql_split('signatures')} AS s, {B.sql_split('knowledge_tags')} AS k FROM v_a),
    c AS (SELECT question_id, video_id, composite, coalesce(qs.question_type = vs.question_type, false) AS same, qs.question_type AS a, vs.question_type AS b, len(list_intersect(qs.s, vs.s)) AS ns, len(list_intersect(qs.anchors, vs.anchors)) AS na, len(list_intersect(qs.k, vs.k)) AS nk FROM qs CROSS JOIN vs),
    r AS (SELECT *, CASE WHEN same THEN 24 ELSE 0 END + CASE WHEN ns > 0 THEN 36 + 6 * least(ns, 2) ELSE 0 END + CASE WHEN na > 0 THEN 22 + 4 * least(na, 4) ELSE 0 END + CASE WHEN nk > 0 THEN 4 * least(nk, 3) ELSE 0 END AS base FROM c
      WHERE same OR (a, b) IN (('科学探究题', '基本实验题'), ('基础题', '综合应用题')) OR (composite AND b = '综合应用题' AND a NOT IN ('科学探究题', '计算题', '工艺流程题', '推断题', '科普阅读题')))"""
_SQL_RANKED = "row_number() OVER (PARTITION BY question_id ORDER BY score DESC, video_id) AS rnk"


@REG.add(
    "family_score_v3",
    f"WITH {_SQL_V3}, t AS (SELECT question_id, video_id, CAST(base AS INT) AS score FROM r WHERE base >= 76) SELECT question_id, CAST(rnk AS INT) AS rnk, video_id, score FROM (SELECT *, {_SQL_RANKED} FROM t) WHERE rnk <= 12",
)
def family_score_v3(spark: SparkSession, d: str) -> DataFrame:
    """The twelve best videos of each question by the third generation, from its threshold, without evidence."""
    return best_v3(spark, d, evidence=False).select("question_id", "rnk", "video_id", "score")


_SQL_EV = f"""e AS (SELECT video_id || '#' || i AS eid, video_id, i, part FROM (SELECT video_id, unnest(a) AS part, unnest(range(1, len(a) + 1)) AS i FROM (SELECT video_id, list_filter(regexp_split_to_array(coalesce(content_summary, ''), '[；;。，, \\n]+'), lambda z: z <> '') AS a FROM v))),
{sql_families('e', 'eid', 'part')}"""


def _sql_whole(generation: str) -> str:
    points = " + ".join(f"CASE WHEN n_{b.family} > 0 THEN {b.base} + {b.step} * least(n_{b.family}, {b.most}) ELSE 0 END" for b in P.SCORES[generation])
    anything = " OR ".join(f"n_{b.family} > 0" for b in P.SCORES[generation])
    gate = "r.type_q IS NOT NULL" + (" OR n_task_model > 0" if generation == "v5" else "")
    best = " + ".join(f"{p} * len(list_intersect(qf.{n}, ef.{n}))" for n, p in P.EVIDENCE[generation].items())
    return f"""{_sql_family(generation)}, {_SQL_EV}, pts AS (SELECT qf.question_id, e.video_id, max({best}) AS points FROM q_f qf CROSS JOIN e JOIN e_f ef USING (eid) GROUP BY 1, 2),
    wide AS (SELECT cnt.*, coalesce(points, 0) AS points, q.question_type AS type_q, v.question_type AS type_v FROM cnt JOIN q USING (question_id) JOIN v USING (video_id) LEFT JOIN pts USING (question_id, video_id)),
    whole AS (SELECT question_id, video_id, CAST(CASE WHEN w.type_q = w.type_v THEN {P.SAME_TYPE[generation]} ELSE 0 END + CASE WHEN w.type_q = '{P.PROJECT}' AND w.type_v = '{P.PROJECT}' THEN 30 ELSE 0 END + {points} + least(points, {P.MOST[generation]}) AS INT) AS score
      FROM wide w LEFT JOIN routes r ON r.type_q = w.type_q AND r.type_v = w.type_v WHERE ({anything} OR points > 0) AND ({gate}))"""


@REG.add(
    "family_score_v4_evidence",
    f"WITH {_sql_whole('v4')} SELECT question_id, CAST(rnk AS INT) AS rnk, video_id, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, video_id) AS rnk FROM whole WHERE score >= {P.LEAST['v4']}) WHERE rnk <= 12",
)
def family_score_v4_evidence(spark: SparkSession, d: str) -> DataFrame:
    """``family_score_v4`` with the points for the best part of the evidence, and for two projects, before threshold and twelve best."""
    return _top12(spark, d, evidence=True, generation="v4", least=P.LEAST["v4"]).select("question_id", "rnk", "video_id", "score")


@REG.add(
    "visual_gate",
    f"""WITH {_SQL_V3}, {_SQL_EV},
    en AS (SELECT e.*, v.video_name FROM e JOIN v USING (video_id)), {_sql_anchors('en', 'video_id', 'part', ", concat(part, coalesce(video_name, '')) AS said")},
    pts AS (SELECT question_id, video_id, max(12 * len(list_intersect(q_a.anchors, en_a.anchors)) + 3 * len(list_filter(q_a.anchors, lambda z: contains({B.sql_compact('said')}, {B.sql_compact('z')})))) AS points FROM q_a CROSS JOIN en_a GROUP BY 1, 2),
    t AS (SELECT question_id, video_id, composite, coalesce(points, 0) AS points, CAST(base + least(coalesce(points, 0), 28) AS INT) AS score FROM r LEFT JOIN pts USING (question_id, video_id) WHERE base + least(coalesce(points, 0), 28) >= 76),
    k AS (SELECT * FROM (SELECT *, {_SQL_RANKED} FROM t) WHERE rnk <= 12)
    SELECT question_id, CAST(rnk AS INT) AS rnk, video_id, score, CAST(points AS INT) AS best_part, score >= {SHOWN_FROM} AND points >= {PART_FROM}
      AND sum(CAST(score >= {SHOWN_FROM} AND points >= {PART_FROM} AS INT)) OVER (PARTITION BY question_id ORDER BY rnk ROWS UNBOUNDED PRECEDING) <= CASE WHEN composite THEN 2 ELSE 1 END AS final_show FROM k""",
)
def visual_gate(spark: SparkSession, d: str) -> DataFrame:
    """The twelve best of the third generation with evidence, and which are shown: from 110 points, with a best part of 24, one a
    question and two for composite ones."""
    r = best_v3(spark, d, evidence=True)
    passes = (F.col("score") >= SHOWN_FROM) & (F.col("points") >= PART_FROM)
    shown = K.accept(r, ["question_id"], [F.asc("rnk")], passes, F.when(F.col("composite"), 2).otherwise(1))
    return shown.select("question_id", "rnk", "video_id", "score", F.col("points").cast("int").alias("best_part"), F.col("accepted").alias("final_show"))


_READ = ("background", "visual", "method")


@REG.add(
    "reading_rank",
    f"""WITH {B.Q}, {B.V}, {sql_families('q', 'question_id', 'stem')}, {sql_families('v', 'video_id', 'content_summary')},
    a AS (SELECT {', '.join(_READ)}, min(question_id) AS question_id, count(*) AS n_questions FROM q_f JOIN q USING (question_id) WHERE question_type = '科普阅读题' GROUP BY ALL),
    b AS (SELECT {', '.join(_READ)}, min(video_id) AS video_id, count(*) AS n_videos FROM v_f JOIN v USING (video_id) WHERE question_type = '科普阅读题' GROUP BY ALL),
    x AS (SELECT question_id, video_id, n_questions, n_videos, len(list_intersect(a.background, b.background)) > 0 AS theme, len(list_intersect(list_intersect(a.visual, b.visual), ['曲线图', '表格', '数字化曲线'])) > 0 AND len(list_intersect(list_intersect(a.method, b.method), ['图表信息提取', '控制变量', '数字化曲线分析'])) > 0 AS graph FROM a CROSS JOIN b)
    SELECT question_id, video_id, n_questions, n_videos, CASE WHEN theme AND graph THEN 3 ELSE 2 END AS isomorph_rank FROM x WHERE theme OR graph""",
)
def reading_rank(spark: SparkSession, d: str) -> DataFrame:
    """How alike two pieces of reading material are: by theme, by the form of their data, by both. Material with the same labels is one
    kind, named by its least id and counted; ``reading_kinds`` has the membership. Pairs that are not alike are left out."""
    q, v = _reading(spark, d)
    a = q.groupBy(*_READ).agg(F.min("question_id").alias("question_id"), F.count(F.lit(1)).alias("n_questions"))
    b = v.groupBy(*_READ).agg(F.min("video_id").alias("video_id"), F.count(F.lit(1)).alias("n_videos"))
    forms, methods = [F.array(*map(F.lit, x)) for x in (["曲线图", "表格", "数字化曲线"], R.READING_METHODS)]
    sets = {"background": F.col("background"), "visual": F.array_intersect("visual", forms)}
    met = P.shared_counts(P.tag_rows(a, "question_id", sets), P.tag_rows(b, "video_id", sets), "question_id", "video_id", list(sets))
    side = lambda df, key, n, x: df.select(key, n, F.array_intersect("method", methods).alias(f"m_{x}"))
    both = met.join(side(a, "question_id", "n_questions", "q"), "question_id").join(side(b, "video_id", "n_videos", "v"), "video_id")
    theme, graph = F.col("n_background") > 0, (F.col("n_visual") > 0) & F.arrays_overlap("m_q", "m_v")
    return both.where(theme | graph).select("question_id", "video_id", "n_questions", "n_videos", F.when(theme & graph, 3).otherwise(2).alias("isomorph_rank"))


def _reading(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    reading = F.col("question_type") == "科普阅读题"
    q = L.with_families(B.questions(spark, d, "stem", "question_type").where(reading), "stem").select("question_id", *_READ)
    return q, L.with_families(B.videos(spark, d, "content_summary", "question_type").where(reading), "content_summary").select("video_id", *_READ)


@REG.add(
    "reading_kinds",
    f"""WITH {B.Q}, {B.V}, {sql_families('q', 'question_id', 'stem')}, {sql_families('v', 'video_id', 'content_summary')}, a AS (SELECT question_id, {', '.join(_READ)} FROM q_f JOIN q USING (question_id) WHERE question_type = '科普阅读题'),
    b AS (SELECT video_id, {', '.join(_READ)} FROM v_f JOIN v USING (video_id) WHERE question_type = '科普阅读题')
    SELECT 'question' AS side, question_id AS id, min(question_id) OVER (PARTITION BY {', '.join(_READ)}) AS kind FROM a UNION ALL SELECT 'video', video_id, min(video_id) OVER (PARTITION BY {', '.join(_READ)}) FROM b""",
)
def reading_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The kind of each piece of reading material, by the least id that has its labels."""
    out = []
    for side, key, df in zip(("question", "video"), ("question_id", "video_id"), _reading(spark, d), strict=True):
        kinds = df.groupBy(*_READ).agg(F.min(key).alias("kind"))
        out.append(df.join(kinds, list(_READ)).select(F.lit(side).alias("side"), F.col(key).alias("id"), "kind"))
    return out[0].unionByName(out[1])


@REG.add(
    "analysis_rows",
    f"""WITH {B.Q}, {B.M}, r AS (SELECT question_id, video_name, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, match_id) AS n FROM m WHERE final_show AND video_name <> '' AND score IS NOT NULL AND NOT isnan(score)),
    g AS (SELECT question_id, string_agg(video_name, '；' ORDER BY n) FILTER (n <= 3) AS names, max(score) AS s FROM r GROUP BY 1)
    SELECT q.question_id, coalesce(question_type, '综合题') AS question_type, CAST(qnum AS VARCHAR) AS number, CASE WHEN q.score > 0 THEN q.score || '分，' ELSE '' END || CASE WHEN s < 130 THEN '讲了！' ELSE '命中！' END AS summary,
      CASE WHEN g.question_id IS NOT NULL THEN '✅' WHEN contains(coalesce(raw_qtype, ''), '选择') AND q.score <= 4 THEN '—' ELSE '❌' END AS status, coalesce(names, '无对应解题课') AS videos
    FROM q LEFT JOIN g USING (question_id)""",
)
def analysis_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row per question for the report: type, number, summary, status, the names of its three best final videos."""
    m = B.matches(spark, d, "question_id", "video_name", "score", "final_show").where("final_show AND video_name <> '' AND score IS NOT NULL AND NOT isnan(score)")
    three = K.top_k(m, ["question_id"], [F.desc("score"), F.asc("match_id")], 3, "n")
    g = three.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("n", "video_name"))).alias("r"), F.max("score").alias("s"))
    q = B.questions(spark, d, "question_type", "qnum", "raw_qtype", "score").join(g, "question_id", "left")
    summary = F.concat(F.when(F.col("score") > 0, F.concat(F.col("score"), F.lit("分，"))).otherwise(""), F.when(F.col("s") < 130, "讲了！").otherwise("命中！"))
    status = F.when(F.col("s").isNotNull(), "✅").when(X.text(F.col("raw_qtype")).contains("选择") & (F.col("score") <= 4), "—").otherwise("❌")
    return q.select(
        "question_id", F.coalesce("question_type", F.lit("综合题")).alias("question_type"), F.col("qnum").cast("string").alias("number"), summary.alias("summary"),
        status.alias("status"), F.coalesce(F.array_join("r.video_name", "；"), F.lit("无对应解题课")).alias("videos"),
    )
