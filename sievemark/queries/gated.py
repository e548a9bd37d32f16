"""The fifth generation's match table over the driver's tables, with overrides, edits and adjustments as input relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.operators import gated as G
from sievemark.operators import labels as L
from sievemark.operators import pairs as P
from sievemark.plans import rule_tables as R
from sievemark.queries import Registry
from sievemark.queries import base as B
from sievemark.queries.matching import evidence_parts
from sievemark.queries.texts import sql_families

REG = Registry()

#: Edits of labels (ord, paper_like, low, high, form, only, family, op, tags): a group of questions that belong together, and one question.
_GROUP = ("仿真卷（一）", 1, 3)
EDITS = [
    (1, *_GROUP, "short", ["科普阅读题", "项目式探究题"], "primary_type", "set", ["基础题"]),
    (2, *_GROUP, "short", None, "visual", "remove", ["曲线图", "表格", "图文阅读题组", "题组材料", "流程图"]),
    (3, *_GROUP, "short", None, "method", "remove", ["图表信息提取"]),
    (4, *_GROUP, "long", None, "primary_type", "set", ["科普阅读题"]),
    (5, *_GROUP, "long", None, "visual", "add", ["题组材料", "曲线图", "表格", "图文阅读题组"]),
    (6, *_GROUP, "long", None, "method", "add", ["图表信息提取"]),
    (7, "（二）", 7, 7, None, None, "primary_type", "set", ["工艺流程题"]),
    (8, "（二）", 7, 7, None, None, "visual", "add", ["流程图", "设备流程"]),
    (9, "（二）", 7, 7, None, None, "task_model", "add", ["循环物质判断"]),
]
_EDIT_SCHEMA = "ord int, paper_like string, low int, high int, form string, only array<string>, family string, op string, tags array<string>"
#: Adjustments (paper_like, qnum, ord, op, value, reason, replace) for the least video id.
ADJUSTMENTS = [("卷", 6, 1, "max", 300, "同为曲线读图", False), ("卷", 6, 2, "add", 15, "配专题课", True), ("仿真卷（一）", 9, 1, "set", 75, None, False)]


def _exams(spark: SparkSession, d: str) -> DataFrame:
    """Overrides come from what was shown: every fifth number allows two of the videos shown, every seventh excludes and compares."""
    m = B.matches(spark, d, "paper", "qnum", "video_id", "final_show").where("final_show AND video_id <> '' AND paper IS NOT NULL AND qnum IS NOT NULL")
    lo_hi = m.groupBy("paper", "qnum").agg(F.min("video_id").alias("lo"), F.max("video_id").alias("hi"))
    allow, exclude = F.col("qnum") % 5 == 1, F.col("qnum") % 7 == 3
    labels = {c: F.lit(None).cast("string" if c == "primary_type" else "array<string>") for c in G.EDITED}
    labels["core"] = F.when(exclude, F.array(F.lit("燃烧条件")))
    o = lo_hi.where(allow | exclude).select(
        "paper", "qnum", F.when(allow, "allow").otherwise("exclude").alias("promotion"), F.when(allow, F.array_distinct(F.array("hi", "lo"))).alias("allowed"),
        F.when(exclude, F.array_distinct(F.array("lo", "hi"))).alias("comparison"), F.when(F.col("qnum") % 2 == 0, "人工说明").alias("audit_note"), *[c.alias(n) for n, c in labels.items()],
    )
    q = B.questions(spark, d, "paper", "qnum", "stem", "question_type", "raw_qtype", "score", "difficulty", "has_visual", "problem_tags")
    group = F.when(F.contains(F.coalesce("paper", F.lit("")), F.lit(_GROUP[0])) & F.col("qnum").between(*_GROUP[1:]), F.concat(F.lit("Q"), F.lit(_GROUP[1]), F.lit("-Q"), F.lit(_GROUP[2])))
    return G.exam_labels(q.withColumn("topic_group", group), o, spark.createDataFrame(EDITS, _EDIT_SCHEMA))


def _videos(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Videos, the parts of their summaries as evidence, and adjustments for the least video id."""
    v = B.videos(spark, d, "content_summary", "question_type", "problem_tags")
    e = G.evidence_labels(evidence_parts(v.select("video_id", "content_summary")).withColumn("i", F.col("p") + 1))
    rows = spark.createDataFrame(ADJUSTMENTS, "paper_like string, qnum int, ord int, op string, value int, reason string, replace boolean")
    return G.video_labels(v), e, rows.withColumn("video_id", v.agg(F.min("video_id")).scalar())


# --- the same in SQL, over all pairs ---------------------------------------------------------------

_q = B.sql_quote


def _list(values: list[str]) -> str:
    return "[" + ", ".join(map(_q, values)) + "]::VARCHAR[]"


def _both(a: str, b: str) -> str:
    return f"list_filter({a}, lambda z: list_contains({b}, z))"


def _less(a: str, b: str) -> str:
    return f"list_filter({a}, lambda z: NOT list_contains({b}, z))"


def _any(a: str, values: list[str]) -> str:
    return f"len({_both(a, _list(values))}) > 0"


def _cell(a: str) -> str:
    return f"array_to_string({a}, '、')"


def _sql_edited() -> str:
    """A chain of relations, one for each edit, that ends in ``x9``."""
    out, of = [], "x0"
    for ord_, like, low, high, form, only, family, op, tags in EDITS:
        test = [f"contains(coalesce(paper, ''), {_q(like)})", f"qnum BETWEEN {low} AND {high}"]
        test += [f"{'' if form == 'short' else 'NOT '}short"] if form else []
        test += [f"type0 IN ({', '.join(map(_q, only))})"] if only else []
        if family == "primary_type":
            new = _q(tags[0])
        elif op == "remove":
            new = _less(family, _list(tags))
        else:
            new = f"list_concat({family}, {_less(_list(tags), family)})"
        out.append(f"x{ord_} AS (SELECT * REPLACE (CASE WHEN {' AND '.join(test)} THEN {new} ELSE {family} END AS {family}) FROM {of})")
        of = f"x{ord_}"
    return ", ".join(out)


_TYPE = B.sql_first_case(R.TYPE_CASES["v5"], "r", "p", "coalesce(nullif(question_type, ''), '基础题')")
_has = lambda words: B.sql_has_any("r", "p", words)
_SQL_EXAMS = f"""{B.Q}, {B.V}, {B.M}, {sql_families('q', 'question_id', 'stem')}, {sql_families('v', 'video_id', 'content_summary')},
x0 AS (SELECT q.question_id, q.paper, q.qnum, q.raw_qtype, coalesce(q.score, 0) AS pts, coalesce(q.difficulty, 0) AS difficulty, coalesce(q.has_visual, false) AS has_visual, q.problem_tags, c.r, c.p, f.visual, f.background, f.task, f.task_model, f.method, f.core,
    regexp_matches(coalesce(q.stem, ''), '[（(]\\s*[ABCDＡＢＣＤ]') AND length({B.sql_compact('q.stem')}) < 320 AND NOT contains({B.sql_compact('q.stem')}, '任务一') AS short,
    {_TYPE.replace('question_type', 'q.question_type')} AS type0, {_TYPE.replace('question_type', 'q.question_type')} AS primary_type,
    contains(coalesce(q.paper, ''), {_q(_GROUP[0])}) AND coalesce(q.qnum BETWEEN {_GROUP[1]} AND {_GROUP[2]}, false) AS grouped FROM q JOIN q_c c USING (question_id) JOIN q_f f USING (question_id)),
{_sql_edited()},
y AS (SELECT *, contains(coalesce(raw_qtype, ''), '选择') AS named, primary_type = '工艺流程题' AND NOT {_has(R.PROCESS_CONTEXT)} AND contains(coalesce(raw_qtype, ''), '选择') AS lost FROM x9),
y1 AS (SELECT * REPLACE (CASE WHEN lost THEN '基础题' ELSE primary_type END AS primary_type, {', '.join(f'CASE WHEN lost THEN {_less(f, _list(t))} ELSE {f} END AS {f}' for f, t in R.PROCESS_TAGS.items())}) FROM y),
y2 AS (SELECT *, named AND pts <= 4 AS choice, has_visual OR grouped AS shown, {_has(R.PROMPT_WORDS)} AS prompt, {_has(['二氧化碳', 'CO2'])} AND {_has(['氢氧化钠', 'NaOH'])} AS co2 FROM y1),
y3 AS (SELECT *, CASE WHEN shown THEN 'PDF题图' WHEN prompt THEN '题干明确图表词' ELSE '无' END AS visual_source, {_cell(f"list_filter({_list(R.FALSE_TRIGGERS)}, lambda k: contains(p, k))")} AS false_triggers,
    CASE WHEN NOT choice THEN '非选择题' WHEN primary_type = '科普阅读题' AND (grouped OR {_has(R.READING_WORDS)}) THEN '科普材料题组' WHEN list_contains(task_model, '共存判断') THEN '离子/物质共存选择题'
      WHEN {_has(R.PROCESS_CONTEXT)} AND {_any('visual', ['流程图', '设备流程'])} THEN '含流程图选择题' WHEN {_any('visual', ['曲线图', '柱状图', '数字化曲线'])} OR {_has(R.GRAPH_WORDS)} THEN '坐标图像选择题'
      WHEN {_has(R.TABLE_WORDS)} AND list_contains(visual, '表格') AND (list_contains(method, '守恒/方程式计算') OR {_has(R.REACTION_WORDS)}) THEN '表格计算选择题' ELSE '' END AS why,
    named AND pts <= 3 AND NOT shown AND length(r) < 320 AND NOT prompt AND ({_has(R.LIFE_WORDS)} OR difficulty <= 3) AND NOT {_any('task_model', R.ALLOWED_TASKS)} AS basic_filter FROM y2),
ov AS (SELECT paper, qnum, CASE WHEN qnum % 5 = 1 THEN 'allow' ELSE 'exclude' END AS promotion, CASE WHEN qnum % 5 = 1 THEN CASE WHEN min(video_id) = max(video_id) THEN [min(video_id)] ELSE [max(video_id), min(video_id)] END END AS allowed,
    CASE WHEN qnum % 7 = 3 THEN CASE WHEN min(video_id) = max(video_id) THEN [min(video_id)] ELSE [min(video_id), max(video_id)] END END AS comparison, CASE WHEN qnum % 2 = 0 THEN '人工说明' END AS audit_note,
    CASE WHEN qnum % 7 = 3 THEN ['燃烧条件'] END AS new_core FROM m WHERE final_show AND video_id <> '' AND paper IS NOT NULL AND qnum IS NOT NULL AND (qnum % 5 = 1 OR qnum % 7 = 3) GROUP BY paper, qnum),
ex AS (SELECT question_id, y3.paper, y3.qnum, CASE WHEN basic_filter THEN '基础常识选择题' ELSE primary_type END AS primary_type, visual, background, task, task_model, method, coalesce(new_core, core) AS core, co2, choice AND why = '' AS choice_filter,
    CASE WHEN why = '' THEN '非白名单选择题' ELSE why END AS choice_reason, basic_filter, visual_source, false_triggers, coalesce(promotion, 'auto') AS promotion, coalesce(allowed, []::VARCHAR[]) AS allowed, coalesce(comparison, []::VARCHAR[]) AS comparison,
    coalesce(audit_note, '') AS audit_note, {_any('task_model', R.ALLOWED_TASKS)} AS allowed_task, {_any(f"list_concat(task, {B.sql_split('problem_tags')})", R.READING_TASKS)} AS entry,
    (choice AND why = '') OR (basic_filter AND NOT {_any('task_model', R.ALLOWED_TASKS)}) AS gated FROM y3 LEFT JOIN ov ON ov.paper = y3.paper AND ov.qnum = y3.qnum)"""

_COLUMNS = ["primary_type", "choice_filter", "choice_reason", "basic_filter", "visual_source", "false_triggers", "promotion", "audit_note", "co2", "gated"]


@REG.add(
    "exam_labels",
    f"WITH {_SQL_EXAMS} SELECT question_id, {', '.join(_COLUMNS)}, {', '.join(f'{_cell(f)} AS {f}' for f in L.FAMILIES)}, array_to_string(allowed, ',') AS allowed, array_to_string(comparison, ',') AS comparison FROM ex",
)
def exam_labels(spark: SparkSession, d: str) -> DataFrame:
    """Questions with labels after edits, demotion, filters and overrides."""
    x = _exams(spark, d)
    return x.select("question_id", *_COLUMNS, *[F.array_join(f, "、").alias(f) for f in L.FAMILIES], F.array_join("allowed", ",").alias("allowed"), F.array_join("comparison", ",").alias("comparison"))


_OVER = {f: _both(f"x.{f}", f"w.{f}") for f in L.FAMILIES}
_OVER["background"] = f"CASE WHEN x.co2 THEN {_OVER['background']} ELSE list_filter({_OVER['background']}, lambda z: z <> 'NaOH与CO2') END"
_OVER["core"] = f"CASE WHEN x.co2 THEN {_OVER['core']} ELSE list_filter({_OVER['core']}, lambda z: z <> 'NaOH与CO2反应证明') END"
_ROUTED = "(a = b OR " + " OR ".join(f"(a = {_q(x)} AND b = {_q(y)})" for x, y in R.ROUTES["v5"]) + ")"
_POINTS = " + ".join(f"CASE WHEN len(o_{b.family}) > 0 THEN {b.base} + {b.step} * least(len(o_{b.family}), {b.most}) ELSE 0 END" for b in P.SCORES["v5"])
_FORMS, _METHODS = _both("o_visual", _list(R.READING_FORMS)), _both("o_method", _list(R.READING_METHODS))
_PART_POINTS = " + ".join(f"{w} * len({_both(f'q_{f}', f'e.{f}')})" for f, w in P.EVIDENCE["v5"].items())
_NOTE = "concat_ws('，', " + ", ".join(f"CASE WHEN len({_both(f'q_{f}', f'e.{f}')}) > 0 THEN {_q(t)} || {_cell(_both(f'q_{f}', f'e.{f}'))} END" for t, f in R.NOTE_LABELS) + ")"


def _sql_adjust(score: str) -> str:
    """The adjustments folded by hand: the score, and the list of reasons."""
    six, nine = "(contains(coalesce(paper, ''), '卷') AND qnum = 6 AND video_id = least_id)", "(contains(coalesce(paper, ''), '仿真卷（一）') AND qnum = 9 AND video_id = least_id)"
    return f"CASE WHEN {six} THEN greatest({score}, 300) + 15 WHEN {nine} THEN 75 ELSE {score} END AS adj, CASE WHEN {six} THEN ['配专题课'] ELSE reasons END AS why"


_ROLES = "list_concat(list_concat(list_concat(o_visual, o_task_model), list_concat(o_task, o_method)), CASE WHEN core_ok THEN o_core ELSE []::VARCHAR[] END)"
_DISTINCT = lambda a: f"list_filter({a}, lambda z, i: list_position({a}, z) = i)"
_W = {k: _q(t) for k, t in R.WHY.items()}
_SQL_MATCHES = f"""{_SQL_EXAMS},
e0 AS (SELECT video_id || '#' || i AS eid, video_id, i, part FROM (SELECT video_id, unnest(a) AS part, unnest(range(1, len(a) + 1)) AS i FROM (SELECT video_id, list_filter(regexp_split_to_array(coalesce(content_summary, ''), '[；;。，, \\n]+'), lambda z: z <> '') AS a FROM v))),
{sql_families('e0', 'eid', 'part')}, e AS (SELECT e0.video_id, e0.i, e0.eid, visual, task, task_model, method FROM e0 JOIN e0_f USING (eid)),
w AS (SELECT v.video_id, {_TYPE.replace('question_type', 'v.question_type')} AS primary_type, visual, background, task, task_model, method, core, {_any(f"list_concat(task, {B.sql_split('v.problem_tags')})", R.READING_TASKS)} AS entry FROM v JOIN v_c USING (video_id) JOIN v_f USING (video_id)),
pr AS (SELECT x.question_id, x.paper, x.qnum, w.video_id, (SELECT min(video_id) FROM v) AS least_id, x.primary_type AS a, w.primary_type AS b, x.gated, x.allowed_task, x.choice_filter, x.choice_reason, x.basic_filter, x.visual_source, x.false_triggers, x.promotion, x.allowed, x.comparison, x.audit_note,
    x.entry AND w.entry AS entries, {', '.join(f'x.{f} AS q_{f}' for f in P.EVIDENCE['v5'])}, list_contains(x.method, '控制变量') OR list_contains(w.method, '控制变量') AS controlled, {', '.join(f'{o} AS o_{f}' for f, o in _OVER.items())} FROM ex x CROSS JOIN w),
p1 AS (SELECT *, a = '科普阅读题' AND b = '科普阅读题' AS reading, CASE WHEN a = b THEN 30 ELSE 0 END + CASE WHEN a = '项目式探究题' AND b = '项目式探究题' THEN 30 ELSE 0 END + {_POINTS} AS base,
    promotion = 'allow' AND list_contains(allowed, video_id) AS listed, NOT gated AND ({_ROUTED} OR len(o_task_model) > 0 OR (promotion = 'allow' AND list_contains(allowed, video_id))) AND NOT (a = '科普阅读题' AND b = '工艺流程题' AND len(o_visual) = 0) AS open,
    (a = b AND len(o_visual) > 0) OR len(o_task_model) > 0 AS fits FROM pr),
need AS (SELECT * FROM p1 WHERE open OR list_contains(comparison, video_id)),
ev AS (SELECT n.question_id, n.video_id, list({{'neg': -({_PART_POINTS}), 'i': e.i, 'eid': e.eid, 'note': CASE WHEN {_NOTE} <> '' THEN {_NOTE} || '。' ELSE '' END}} ORDER BY e.i) AS all_parts FROM need n JOIN e USING (video_id) GROUP BY 1, 2),
p2 AS (SELECT n.*, coalesce(all_parts, []) AS all_parts, list_sort(list_filter(coalesce(all_parts, []), lambda z: z.neg < 0 OR fits)) AS found FROM need n LEFT JOIN ev USING (question_id, video_id)),
p3 AS (SELECT *, CASE WHEN NOT reading OR NOT entries THEN '' WHEN {_any('o_visual', ['曲线图', '数字化曲线'])} THEN '信息提取+曲线图' WHEN list_contains(o_visual, '表格') THEN '信息提取+数据表' WHEN controlled THEN '信息提取+控制变量分析'
    WHEN len({_FORMS}) > 0 THEN '信息提取+' || {_cell(_FORMS)} WHEN len({_METHODS}) > 0 THEN '信息提取+' || {_cell(_METHODS)} ELSE '' END AS form, reading AND len(o_background) > 0 AS theme,
    reading AND {_any('o_visual', ['曲线图', '表格', '数字化曲线'])} AND {_any('o_method', R.READING_METHODS)} AS data, base + least(coalesce(-found[1].neg, 0), {P.MOST['v5']}) AS s0 FROM p2),
p4 AS (SELECT *, CASE WHEN form <> '' THEN greatest(s0, 115) ELSE s0 END + CASE WHEN theme THEN 30 ELSE 0 END + CASE WHEN data THEN 30 ELSE 0 END AS s1, CASE WHEN theme AND data THEN 3 WHEN theme OR data THEN 2 ELSE 0 END AS rank0,
    list_filter([CASE WHEN a = b THEN '同为' || a END, {', '.join(f"CASE WHEN len(o_{f}) > 0 THEN {_q(t)} || {_cell(f'o_{f}')} END" for t, f in R.REASON_LABELS)}, CASE WHEN a = '项目式探究题' AND b = '项目式探究题' THEN '同为项目式探究题，均以真实情境任务链考查综合解决问题' END,
      CASE WHEN form <> '' THEN '科普阅读形式相似：' || form END, CASE WHEN theme THEN '素材主题与课内例题同构，宣传版截图前置' END, CASE WHEN data THEN '数据作答方式与课内例题同构，宣传版截图前置' END], lambda z: z IS NOT NULL) AS reasons FROM p3),
p5 AS (SELECT *, {_sql_adjust('s1')} FROM p4),
p6 AS (SELECT *, CASE WHEN NOT open THEN 0 WHEN listed THEN greatest(adj, 480 - 20 * (list_position(allowed, video_id) - 1)) ELSE adj END AS score, array_to_string(why, '；') AS told, coalesce(nullif(audit_note, ''), {_W['listed']}) AS remark,
    CASE WHEN a IN ('项目式探究题', '综合应用题') THEN {G.SHOWN_LONG} ELSE {G.SHOWN} END AS many FROM p5),
p7 AS (SELECT *, CASE WHEN NOT open THEN '' WHEN NOT listed THEN told WHEN told = '' THEN remark WHEN contains(told, remark) THEN told ELSE told || '；' || remark END AS hit_reason, CASE WHEN listed AND len(found) = 0 THEN all_parts[1:many] ELSE found END AS chosen FROM p6),
p8 AS (SELECT *, CASE WHEN score < {P.LEAST['v5']} THEN {_W['low']} WHEN len(chosen) = 0 THEN {_W['none_shown']} ELSE '' END AS reject, CASE WHEN NOT open THEN [] WHEN score < {P.LEAST['v5']} THEN chosen[1:{G.SHOWN_LONG}] ELSE chosen[1:many] END AS shown FROM p7),
best AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, video_id) AS rnk FROM p8 WHERE score > 0 QUALIFY rnk <= {G.BEST}),
r0 AS (SELECT *, len(o_core) > 0 AND a IN ('基本实验题', '科学探究题') AS core_ok, promotion = 'exclude' OR (promotion = 'allow' AND NOT list_contains(allowed, video_id)) AS manual, promotion = 'allow' AS allow_, len(o_task_model) > 0 OR len(o_method) > 0 OR len(o_task) > 0 AS alike FROM best),
r1 AS (SELECT *, CASE WHEN manual THEN '否' WHEN len(o_visual) > 0 THEN '是' WHEN alike THEN '一般' WHEN allow_ THEN '是' ELSE '否' END AS first_eye, CASE WHEN manual THEN '否' WHEN allow_ OR {_ROUTED} OR len(o_task_model) > 0 THEN '是' ELSE '否' END AS same_pool,
    CASE WHEN manual THEN '否' WHEN allow_ OR {' OR '.join(f"contains(hit_reason, {_q(x)})" for x in R.SPECIFIC_WORDS)} THEN '是' ELSE '否' END AS specific, CASE WHEN manual THEN '是' WHEN allow_ OR len(o_visual) > 0 OR alike OR core_ok THEN '否' ELSE '是' END AS only_chapter,
    CASE WHEN manual THEN '' ELSE {_cell(_DISTINCT(_ROLES))} END AS roles,
    CAST(len(o_visual) > 0 AND visual_source <> '无' AS INT) + CAST(len(o_task_model) > 0 AS INT) + CAST(len(o_method) > 0 AS INT) + CAST(a = b AND a NOT IN ('基础题', '基础常识选择题') AS INT) + CAST(core_ok AS INT) AS support FROM r0),
r2 AS (SELECT *, CASE WHEN promotion = 'exclude' THEN coalesce(nullif(audit_note, ''), {_W['excluded']}) WHEN manual THEN '不在人工白名单：' || coalesce(nullif({_cell('list_sort(allowed)')}, ''), '无') WHEN reject <> '' THEN reject WHEN allow_ AND len(shown) = 0 THEN {_W['no_part']}
    WHEN allow_ THEN coalesce(nullif(audit_note, ''), {_W['allowed']}) WHEN choice_filter THEN {_W['choice']} WHEN basic_filter AND NOT allowed_task THEN {_W['basic']} WHEN visual_source = '无' AND a IN ('工艺流程题', '科学探究题', '项目式探究题') AND NOT allowed_task THEN {_W['no_visual']}
    WHEN only_chapter = '是' THEN {_W['chapter']} WHEN first_eye = '否' AND NOT (len(o_task_model) > 0 OR len(o_method) > 0) THEN {_W['first_eye']} WHEN a = '科普阅读题' AND first_eye <> '是' THEN {_W['reading']} WHEN same_pool = '否' THEN {_W['pool']} WHEN specific = '否' THEN {_W['vague']}
    WHEN len(shown) = 0 THEN {_W['no_part']} WHEN support < 2 AND NOT allowed_task THEN {_W['support']} ELSE {_W['passed']} END AS review_reason,
    CASE WHEN promotion = 'exclude' OR manual OR reject <> '' THEN '降级过程库' WHEN allow_ THEN CASE WHEN len(shown) = 0 THEN '替换截图' ELSE '保留' END WHEN choice_filter OR (basic_filter AND NOT allowed_task) OR (visual_source = '无' AND a IN ('工艺流程题', '科学探究题', '项目式探究题') AND NOT allowed_task) OR only_chapter = '是'
      OR (first_eye = '否' AND NOT (len(o_task_model) > 0 OR len(o_method) > 0)) OR (a = '科普阅读题' AND first_eye <> '是') OR same_pool = '否' THEN '降级过程库' WHEN specific = '否' OR len(shown) = 0 THEN '替换截图' WHEN support < 2 AND NOT allowed_task THEN '降级过程库' ELSE '保留' END AS final_review FROM r1),
r3 AS (SELECT *, final_review = '保留' AND sum(CAST(final_review = '保留' AS INT)) OVER (PARTITION BY question_id ORDER BY score DESC, video_id ROWS UNBOUNDED PRECEDING)
    <= CASE WHEN allow_ AND len(allowed) > 0 THEN len(allowed) WHEN a IN ('项目式探究题', '综合应用题') THEN 3 WHEN a IN ('科普阅读题', '工艺流程题') THEN 2 ELSE 1 END AS accepted FROM r2),
rows_ AS (SELECT question_id || '__' || video_id AS match_id, question_id, paper, qnum, a AS primary_type, video_id, b AS video_type, score, hit_reason, rank0 AS isomorph_rank, form AS popsci_form, shown, CASE WHEN accepted THEN '' WHEN reject <> '' THEN reject WHEN final_review = '保留' THEN {_W['stronger']} ELSE review_reason END AS reject_reason,
    accepted AS final_show, false AS comparison_only, first_eye, same_pool, specific, roles, only_chapter, basic_filter, choice_filter, choice_reason, visual_source, false_triggers, final_review, review_reason FROM r3),
none_ AS (SELECT question_id || '__NO_MATCH', question_id, paper, qnum, primary_type, '', '', 0, '', 0, '', [], CASE WHEN choice_filter THEN {_W['choice']} WHEN basic_filter THEN {_W['basic']} ELSE {_W['no_match']} END, false, false, '否', '否', '否', '', '是', basic_filter, choice_filter, choice_reason, visual_source, false_triggers, '降级过程库',
    CASE WHEN choice_filter THEN {_W['choice']} WHEN basic_filter THEN {_W['basic']} ELSE {_W['no_match']} END FROM ex WHERE question_id NOT IN (SELECT question_id FROM rows_ WHERE final_show)),
comp AS (SELECT question_id || '__' || video_id || '__COMPARE', question_id, paper, qnum, a, video_id, b, CASE WHEN len(shown) = 0 THEN greatest(score, 100) ELSE score END, CASE WHEN len(shown) = 0 AND hit_reason = '' THEN {_W['compared_listed']} ELSE hit_reason END, CASE WHEN open THEN rank0 ELSE 0 END, CASE WHEN open THEN form ELSE '' END,
    CASE WHEN len(shown) = 0 THEN all_parts[1:1] ELSE shown END, '', true, true, '一般', '是', '是', '', '否', basic_filter, choice_filter, choice_reason, visual_source, false_triggers, '保留', coalesce(nullif(audit_note, ''), {_W['compared']})
    FROM p8 WHERE list_contains(comparison, video_id) AND len(all_parts) > 0 AND (question_id, video_id) NOT IN (SELECT (question_id, video_id) FROM rows_ WHERE final_show)),
every AS (SELECT * FROM rows_ UNION ALL SELECT * FROM none_ UNION ALL SELECT * FROM comp),
table_ AS (SELECT * EXCLUDE (shown), array_to_string(list_transform(shown, lambda z: z.eid), '；') AS screenshot_ids, array_to_string(list_transform(shown, lambda z: CASE WHEN z.note <> '' THEN z.note ELSE hit_reason[1:80] END), '；') AS screenshot_notes FROM every)"""


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return G.match_rows(_exams(spark, d), *_videos(spark, d))


@REG.add("match_table", f"WITH {_SQL_MATCHES} SELECT {', '.join(c if c not in ('score', 'isomorph_rank') else f'CAST({c} AS INT) AS {c}' for c in G.OUT)} FROM table_")
def match_table(spark: SparkSession, d: str) -> DataFrame:
    """The whole match table: gates, score with evidence, adjustments, white lists, review, quotas, NO_MATCH and comparison rows."""
    return _matches(spark, d)
