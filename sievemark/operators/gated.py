"""Matching with gates, evidence, adjustments, a review and quotas: the fifth generation as one pipeline over relations.

``exam_labels`` gives questions their labels, filters and overrides, ``video_labels`` and ``evidence_labels`` the other
side. ``candidates`` finds every pair that may be among the best of its question without forming pairs one by one: score
follows from labels, so kinds of labels are scored, and each kind of video is stood for by its least ids. ``details``
works out what a match row holds, for those few pairs; ``match_rows`` reviews, ranks, accepts and fills up.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.functions import text as X
from sievemark.functions.rules import cascade, has_any
from sievemark.operators import labels as L
from sievemark.operators import pairs as P
from sievemark.operators import ranking as K
from sievemark.operators.review import decide, support
from sievemark.plans import rule_tables as R
from sievemark.session import durable

READING, PROCESS, PROJECT = "科普阅读题", "工艺流程题", "项目式探究题"
#: Rows an edit or adjustment table may hold: they are broadcast.
MAX_ROWS = 100_000
#: Matches ranked and reviewed for each question; parts of the evidence shown for long types, and for others.
BEST, SHOWN_LONG, SHOWN = 12, 6, 3
#: The columns in which an edit can change labels.
EDITED = (*L.FAMILIES, "primary_type")


def small(df: DataFrame, what: str) -> DataFrame:
    """``df`` to be broadcast, after a check that it has ``MAX_ROWS`` rows at most."""
    if df.limit(MAX_ROWS + 1).count() > MAX_ROWS:
        raise ValueError(f"{what} has more than {MAX_ROWS} rows")
    return F.broadcast(df)


def _lits(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def edit_labels(df: DataFrame, edits: DataFrame, keys: Sequence[str] = ("paper",)) -> DataFrame:
    """Labels (``EDITED`` columns of ``df``) changed by a table of edits in their order (``ord``).

    An edit is for rows whose ``keys`` columns contain its ``<key>_like`` texts (null for any), whose ``qnum`` lies between
    ``low`` and ``high`` (null for any), whose type is one of ``only`` (null for any) before all edits, and which are a
    short choice question (``form`` 'short'), any other ('long') or either (null). ``op`` is ``add``, ``remove`` or ``set``,
    ``tags`` what is added to, taken from or put in the ``family``. ``df`` has ``question_id`` or ``video_id`` as key.
    """
    key = "question_id" if "question_id" in df.columns else "video_id"
    fits = [F.col(f"{k}_like").isNull() | F.contains(F.coalesce(F.col(k), F.lit("")), F.col(f"{k}_like")) for k in keys]
    if "qnum" in df.columns:
        fits += [F.col("low").isNull() | F.col("qnum").between(F.col("low"), F.col("high")), F.col("form").isNull() | (F.col("form") == F.when(F.col("short"), "short").otherwise("long"))]
    fits.append(F.col("only").isNull() | F.array_contains("only", F.col("primary_type")))
    rows = df.select(key, *keys, *[c for c in ("qnum", "short", "primary_type") if c in df.columns])
    todo = rows.join(small(edits, "the table of edits"), reduce(lambda a, b: a & b, fits)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "family", "op", "tags"))).alias("_todo"))
    both = df.join(todo, key, "left").withColumn("_todo", F.coalesce("_todo", F.array().cast("array<struct<ord:int,family:string,op:string,tags:array<string>>>")))

    def edited(family: str, start: Column) -> Column:
        mine = F.filter("_todo", lambda e: e["family"] == family)
        step = lambda acc, e: F.when(e["op"] == "add", F.array_union(acc, e["tags"])).when(e["op"] == "remove", F.array_except(acc, e["tags"])).otherwise(e["tags"])
        return F.aggregate(mine, start, step)

    new = {f: edited(f, F.col(f)) for f in L.FAMILIES} | {"primary_type": F.get(edited("primary_type", F.array("primary_type")), F.lit(0))}
    return both.withColumns(new).drop("_todo")


def choice_reason() -> Column:
    """Why a choice question may take part ("" if it may not); for a prepared text with families and ``choice``."""
    raw, packed = F.col("_raw"), F.col("_packed")
    has = lambda words: has_any(raw, words, packed)
    some = lambda family, names: F.arrays_overlap(family, _lits(names))
    graph = some("visual", ["曲线图", "柱状图", "数字化曲线"]) | has(R.GRAPH_WORDS)
    table = has(R.TABLE_WORDS) & F.array_contains("visual", "表格") & (F.array_contains("method", "守恒/方程式计算") | has(R.REACTION_WORDS))
    return cascade(
        [
            (~F.col("choice"), R.CHOICE_WHY["free"]),
            ((F.col("primary_type") == READING) & (F.col("topic_group").isNotNull() | has(R.READING_WORDS)), R.CHOICE_WHY["reading"]),
            (F.array_contains("task_model", "共存判断"), R.CHOICE_WHY["coexist"]),
            (L.process_context(raw, packed) & some("visual", ["流程图", "设备流程"]), R.CHOICE_WHY["process"]),
            (graph, R.CHOICE_WHY["graph"]),
            (table, R.CHOICE_WHY["table"]),
        ],
        "",
    )


def exam_labels(q: DataFrame, overrides: DataFrame, edits: DataFrame) -> DataFrame:
    """Questions with labels, filters and overrides, a row per ``question_id``.

    ``q`` has ``question_id, paper, qnum, stem, question_type, raw_qtype, score, difficulty, has_visual, topic_group,
    problem_tags``. ``overrides`` has a row per ``paper`` and ``qnum``: ``promotion`` (allow, exclude or null for auto),
    ``allowed`` and ``comparison`` (ordered arrays of video ids), ``audit_note`` and the label columns, which replace
    labels where not null. The order is: labels, edits, demotion, evidence source, choice filter, basic filter, overrides.
    """
    compacted = X.compact(F.col("stem"))
    short = X.text(F.col("stem")).rlike(r"[（(]\s*[ABCDＡＢＣＤ]") & (F.length(compacted) < 320) & ~compacted.contains("任务一")
    rows = L.with_families(q.withColumn("short", short), "stem").withColumn("stem", X.clean_stem(F.col("stem")))
    typed = L.prepare(rows, "stem").withColumn("primary_type", L.question_type(F.coalesce(F.nullif("question_type", F.lit("")), F.lit("基础题"))))
    typed = edit_labels(typed, edits)
    raw, packed = F.col("_raw"), F.col("_packed")
    named = X.text(F.col("raw_qtype")).contains("选择")
    lost = (F.col("primary_type") == PROCESS) & ~L.process_context(raw, packed) & named
    typed = typed.withColumn("_lost", F.coalesce(lost, F.lit(False)))
    typed = typed.withColumns({f: F.when(F.col("_lost"), F.array_except(f, _lits(names))).otherwise(F.col(f)) for f, names in R.PROCESS_TAGS.items()})
    typed = typed.withColumn("primary_type", F.when(F.col("_lost"), "基础题").otherwise(F.col("primary_type")))
    prompt = has_any(raw, R.PROMPT_WORDS, packed)
    shown = F.coalesce("has_visual", F.lit(False)) | F.col("topic_group").isNotNull()
    points = F.coalesce("score", F.lit(0))
    typed = typed.withColumns({
        "choice": named & (points <= 4),
        "visual_source": cascade([(shown, "PDF题图"), (prompt, "题干明确图表词")], "无"),
        "false_triggers": X.join_tags(F.filter(_lits(R.FALSE_TRIGGERS), lambda k: packed.contains(k))),
        "co2": has_any(raw, ["二氧化碳", "CO2"], packed) & has_any(raw, ["氢氧化钠", "NaOH"], packed),
    })
    typed = typed.withColumn("_why", choice_reason())
    easy = has_any(raw, R.LIFE_WORDS, packed) | (F.coalesce("difficulty", F.lit(0)) <= 3)
    basic = named & (points <= 3) & ~shown & (F.length(raw) < 320) & ~prompt & easy & ~F.arrays_overlap("task_model", _lits(R.ALLOWED_TASKS))
    typed = typed.withColumns({"choice_filter": F.col("choice") & (F.col("_why") == ""), "choice_reason": F.when(F.col("_why") == "", R.CHOICE_WHY["other"]).otherwise(F.col("_why")), "basic_filter": basic})
    typed = typed.withColumn("primary_type", F.when(F.col("basic_filter"), "基础常识选择题").otherwise(F.col("primary_type")))
    o = overrides.select("paper", "qnum", "promotion", "allowed", "comparison", "audit_note", *[F.col(c).alias(f"_{c}_new") for c in EDITED])
    out = typed.join(o, ["paper", "qnum"], "left").withColumns({c: F.coalesce(F.col(f"_{c}_new"), F.col(c)) for c in EDITED})
    empty = F.array().cast("array<string>")
    whitelist = F.arrays_overlap("task_model", _lits(R.ALLOWED_TASKS))
    out = out.withColumns({
        "promotion": F.coalesce("promotion", F.lit("auto")), "allowed": F.coalesce("allowed", empty), "comparison": F.coalesce("comparison", empty), "audit_note": F.coalesce("audit_note", F.lit("")),
        "allowed_task": whitelist, "entry": F.arrays_overlap(F.array_union("task", X.split_tags(F.col("problem_tags"))), _lits(R.READING_TASKS)),
    })
    return out.withColumn("gated", F.col("choice_filter") | (F.col("basic_filter") & ~F.col("allowed_task"))).select(
        "question_id", "paper", "qnum", "primary_type", *L.FAMILIES, "co2", "entry", "gated", "allowed_task", "choice_filter", "choice_reason", "basic_filter", "visual_source",
        "false_triggers", "promotion", "allowed", "comparison", "audit_note",
    )


def video_labels(v: DataFrame) -> DataFrame:
    """``video_id``, ``primary_type``, families and ``entry`` of videos with ``video_id, content_summary, question_type, problem_tags``."""
    rows = L.prepare(L.with_families(v, "content_summary"), "content_summary", clean=True)
    typed = rows.withColumn("primary_type", L.question_type(F.coalesce(F.nullif("question_type", F.lit("")), F.lit("基础题"))))
    entry = F.arrays_overlap(F.array_union("task", X.split_tags(F.col("problem_tags"))), _lits(R.READING_TASKS))
    return typed.select("video_id", "primary_type", *L.FAMILIES, entry.alias("entry"))


def evidence_labels(parts: DataFrame) -> DataFrame:
    """``(video_id, i, eid, visual, task, task_model, method)`` of evidence parts (``video_id, i, part``, ``i`` from 1)."""
    return L.with_families(parts, "part").select("video_id", "i", F.concat_ws("#", "video_id", "i").alias("eid"), *P.EVIDENCE["v5"])


def _overlaps(df: DataFrame) -> DataFrame:
    """Adds what both sides (columns ``q_*`` and ``v_*``) share, and the score without evidence, its gates and reading bonuses."""
    both = df.withColumns({f"o_{f}": F.array_intersect(f"q_{f}", f"v_{f}") for f in L.FAMILIES})
    for f, tag in (("background", "NaOH与CO2"), ("core", "NaOH与CO2反应证明")):
        both = both.withColumn(f"o_{f}", F.when(F.col("q_co2"), F.col(f"o_{f}")).otherwise(F.array_except(f"o_{f}", _lits([tag]))))
    some = {f: F.size(f"o_{f}") > 0 for f in L.FAMILIES}
    reading = (F.col("q_type") == READING) & (F.col("v_type") == READING)
    base = F.when(F.col("q_type") == F.col("v_type"), P.SAME_TYPE["v5"]).otherwise(0) + F.when((F.col("q_type") == PROJECT) & (F.col("v_type") == PROJECT), 30).otherwise(0)
    for b in P.SCORES["v5"]:
        base = base + F.when(some[b.family], b.base + b.step * F.least(F.size(f"o_{b.family}"), F.lit(b.most))).otherwise(0)
    has = lambda column, names: F.arrays_overlap(column, _lits(names))
    forms, methods = F.array_intersect("o_visual", _lits(R.READING_FORMS)), F.array_intersect("o_method", _lits(R.READING_METHODS))
    form = (
        F.when(~reading | ~F.col("q_entry") | ~F.col("v_entry"), "")
        .when(has("o_visual", ["曲线图", "数字化曲线"]), "信息提取+曲线图")
        .when(has("o_visual", ["表格"]), "信息提取+数据表")
        .when(has("q_method", ["控制变量"]) | has("v_method", ["控制变量"]), "信息提取+控制变量分析")
        .when(F.size(forms) > 0, F.concat(F.lit("信息提取+"), X.join_tags(forms)))
        .when(F.size(methods) > 0, F.concat(F.lit("信息提取+"), X.join_tags(methods)))
        .otherwise("")
    )
    data = has("o_visual", ["曲线图", "表格", "数字化曲线"]) & has("o_method", R.READING_METHODS)
    closed = (F.col("q_type") == READING) & (F.col("v_type") == PROCESS) & ~some["visual"]
    return both.withColumns({"base": base.cast("int"), "form": form, "theme": reading & some["background"], "data": reading & data, "closed": closed})


def _with_evidence(bonus: Column) -> Column:
    """The score with ``bonus`` points of evidence; it never falls as these rise."""
    s = F.col("base") + bonus
    s = F.when(F.col("form") != "", F.greatest(s, F.lit(115))).otherwise(s)
    s = s + F.when(F.col("theme"), 30).otherwise(0) + F.when(F.col("data"), 30).otherwise(0)
    return F.when(F.col("closed"), 0).otherwise(s).cast("int")


def _points(part: Column | None = None) -> Column:
    of = (lambda f: part[f]) if part is not None else (lambda f: F.col(f"e_{f}"))
    return reduce(lambda a, b: a + b, [w * F.size(F.array_intersect(F.col(f"q_{f}"), of(f))) for f, w in P.EVIDENCE["v5"].items()])


def _routes(df: DataFrame) -> DataFrame:
    types = R.ROUTES["v5"]
    return df.sparkSession.createDataFrame(types, "q_type string, v_type string")


def _allowed() -> Column:
    """Whether the types of both sides may be matched."""
    pairs = [(F.col("q_type") == a) & (F.col("v_type") == b) for a, b in R.ROUTES["v5"]]
    return F.coalesce((F.col("q_type") == F.col("v_type")) | reduce(lambda a, b: a | b, pairs), F.lit(False))


def candidates(q: DataFrame, v: DataFrame, e: DataFrame, best: int = BEST) -> DataFrame:
    """``(question_id, video_id)``: the ``best`` videos of each question by score, before adjustments and lists, are among them.

    Kinds (labels) are paired by type route or shared task model. A kind of question needs only the kinds of videos whose
    greatest possible score (with all points of evidence) reaches the least score of its ``best`` surest videos. These are
    scored with each set of labels that a part of their evidence has, and each (kind, part labels) is stood for by its
    ``best`` least ids, which win all ties within it. So the rows depend on the number of kinds, not of pairs.
    """
    own_q = ["primary_type", *L.FAMILIES, "co2", "entry"]
    own_v = ["primary_type", *L.FAMILIES, "entry"]
    q = q.where(~F.col("gated")).withColumn("kq", F.md5(F.to_json(F.struct(*own_q))))
    v = v.withColumn("kv", F.md5(F.to_json(F.struct(*own_v))))
    name = lambda c: "type" if c == "primary_type" else c
    kq = durable(q.groupBy("kq").agg(*[F.first(c).alias(f"q_{name(c)}") for c in own_q]), "kinds")
    kv = durable(v.groupBy("kv").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(f"v_{name(c)}") for c in own_v]), "kinds")
    same = kq.select("kq", F.col("q_type").alias("v_type")).join(kv.select("kv", "v_type"), "v_type").select("kq", "kv")
    routed = kq.select("kq", "q_type").join(F.broadcast(_routes(q)), "q_type").join(kv.select("kv", "v_type"), "v_type").select("kq", "kv")
    modelled = kq.select("kq", F.explode("q_task_model").alias("m")).join(kv.select("kv", F.explode("v_task_model").alias("m")), "m").select("kq", "kv")
    met = same.unionByName(routed).unionByName(modelled).distinct()
    scored = _overlaps(met.join(kq, "kq").join(kv, "kv")).withColumns({"low": _with_evidence(F.lit(0)), "high": _with_evidence(F.lit(P.MOST["v5"]))}).where("high > 0")
    surest = Window.partitionBy("kq").orderBy(F.desc("low"), "kv")
    ahead = F.coalesce(F.sum("n").over(surest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = F.when(F.sum("n").over(Window.partitionBy("kq")) >= best, F.min(F.when(F.col("ahead") < best, F.col("low"))).over(Window.partitionBy("kq"))).otherwise(0)
    kept = scored.withColumn("ahead", ahead).withColumn("cut", cut).where(F.col("high") >= F.col("cut"))
    kept = kept.select("kq", "kv", "base", "form", "theme", "data", "closed", *[f"q_{f}" for f in P.EVIDENCE["v5"]])
    parts = e.select("video_id", F.struct(*P.EVIDENCE["v5"]).alias("part")).join(v.select("video_id", "kv"), "video_id")
    whole = v.select("video_id", F.struct(*[F.array().cast("array<string>").alias(f) for f in P.EVIDENCE["v5"]]).alias("part"), "kv")
    labelled = parts.unionByName(whole).withColumn("kp", F.md5(F.to_json("part"))).select("kv", "kp", "video_id", "part").dropDuplicates(["kv", "kp", "video_id"])
    few = durable(K.top_k(labelled, ["kv", "kp"], [F.asc("video_id")], best, "at").drop("at"), "stand-ins")
    of_kind = few.groupBy("kv", "kp").agg(F.first("part").alias("part"))
    pairs = kept.join(of_kind, "kv").withColumn("s", _with_evidence(F.least(_points(F.col("part")), F.lit(P.MOST["v5"])))).where("s > 0").select("kq", "kv", "kp", "s")
    top = pairs.join(few.select("kv", "kp", "video_id"), ["kv", "kp"]).groupBy("kq", "video_id").agg(F.max("s").alias("s"))
    return K.top_k(top, ["kq"], [F.desc("s"), F.asc("video_id")], best, "at").join(q.select("kq", "question_id"), "kq").select("question_id", "video_id")


def listed_pairs(q: DataFrame, v: DataFrame, adjustments: DataFrame) -> DataFrame:
    """``(question_id, video_id)`` of pairs that a white list or an adjustment names, for videos that exist."""
    allowed = q.where(F.col("promotion") == "allow").select("question_id", F.explode("allowed").alias("video_id"))
    rows = small(adjustments.select("paper_like", F.col("qnum").alias("at"), "video_id"), "the table of adjustments")
    adjusted = q.select("question_id", "paper", "qnum").join(rows, F.contains(F.coalesce("paper", F.lit("")), F.col("paper_like")) & (F.col("qnum") == F.col("at"))).select("question_id", "video_id")
    return allowed.unionByName(adjusted).distinct().join(v.select("video_id"), "video_id", "left_semi").select("question_id", "video_id")


def details(pairs: DataFrame, q: DataFrame, v: DataFrame, e: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Pairs with score, reason, reading rank, the parts of the evidence shown and why a pair would be rejected; a row per pair
    whose score is not closed by a gate has ``score`` above 0.

    ``adjustments`` has ``paper_like, qnum, video_id, ord, op`` (set, max or add), ``value``, ``reason`` and ``replace``
    (the reason replaces those found, else it is appended); they apply in order, after the evidence and before the white list.
    """
    name = lambda c: "type" if c == "primary_type" else c
    qs = q.select("question_id", "paper", "qnum", "gated", "allowed_task", "choice_filter", "choice_reason", "basic_filter", "visual_source", "false_triggers", "promotion", "allowed", "audit_note",
                  *[F.col(c).alias(f"q_{name(c)}") for c in ("primary_type", *L.FAMILIES, "co2", "entry")])
    vs = v.select("video_id", *[F.col(c).alias(f"v_{name(c)}") for c in ("primary_type", *L.FAMILIES, "entry")])
    parts = e.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("i", "eid", *P.EVIDENCE["v5"]))).alias("parts"))
    both = _overlaps(pairs.join(qs, "question_id").join(vs, "video_id").join(parts, "video_id", "left"))
    none = F.array().cast("array<struct<neg:int,i:int,eid:string,note:string>>")
    o = lambda f: F.col(f"o_{f}")
    some = lambda f: F.size(o(f)) > 0
    shared = lambda p, f: X.join_tags(F.array_intersect(F.col(f"q_{f}"), p[f]))
    said = lambda label, text: F.when(text != "", F.concat(F.lit(label), text))

    def note(p: Column) -> Column:
        text = F.concat_ws("，", *[said(t, shared(p, f)) for t, f in R.NOTE_LABELS])
        return F.when(text != "", F.concat(text, F.lit("。"))).otherwise("")

    scored = F.transform(F.coalesce("parts", F.array().cast(both.schema["parts"].dataType)), lambda p: F.struct((-_points(p)).cast("int").alias("neg"), p["i"].alias("i"), p["eid"].alias("eid"), note(p).alias("note")))
    both = both.withColumn("all_parts", scored)
    fits = ((F.col("q_type") == F.col("v_type")) & some("visual")) | some("task_model")
    both = both.withColumn("found", F.array_sort(F.filter("all_parts", lambda p: (p["neg"] < 0) | fits)))
    bonus = F.least(F.coalesce(-F.get("found", F.lit(0))["neg"], F.lit(0)), F.lit(P.MOST["v5"]))
    listed = (F.col("promotion") == "allow") & F.array_contains("allowed", F.col("video_id"))
    open_ = ~F.col("gated") & (_allowed() | some("task_model") | listed) & ~F.col("closed")
    reasons = F.array_compact(F.array(
        F.when(F.col("q_type") == F.col("v_type"), F.concat(F.lit(R.SAID["same_type"]), "q_type")),
        *[F.when(some(f), F.concat(F.lit(t), X.join_tags(o(f)))) for t, f in R.REASON_LABELS],
        F.when((F.col("q_type") == PROJECT) & (F.col("v_type") == PROJECT), R.SAID["projects"]),
        F.when(F.col("form") != "", F.concat(F.lit(R.SAID["form"]), "form")),
        F.when(F.col("theme"), R.SAID["theme"]),
        F.when(F.col("data"), R.SAID["data"]),
    ))
    rank = F.when(F.col("theme") & F.col("data"), 3).when(F.col("theme") | F.col("data"), 2).otherwise(0)
    both = both.withColumns({"score": _with_evidence(bonus), "reasons": reasons, "isomorph_rank": rank, "listed": listed, "open": open_, "fits": fits})
    rows = small(adjustments.select("paper_like", F.col("qnum").alias("at"), F.col("video_id").alias("of"), "ord", "op", "value", "reason", "replace"), "the table of adjustments")
    hit = both.select("question_id", "video_id", "paper", "qnum").join(rows, F.contains(F.coalesce("paper", F.lit("")), F.col("paper_like")) & (F.col("qnum") == F.col("at")) & (F.col("video_id") == F.col("of")))
    todo = hit.groupBy("question_id", "video_id").agg(F.array_sort(F.collect_list(F.struct("ord", "op", "value", "reason", "replace"))).alias("todo"))
    both = both.join(todo, ["question_id", "video_id"], "left").withColumn("todo", F.coalesce("todo", F.array().cast(todo.schema["todo"].dataType)))
    start = F.struct(F.col("score").alias("score"), F.col("reasons").alias("reasons"))

    def adjust(acc: Column, a: Column) -> Column:
        value = F.when(a["op"] == "set", a["value"]).when(a["op"] == "max", F.greatest(acc["score"], a["value"])).otherwise(acc["score"] + a["value"])
        why = F.when(a["reason"].isNull(), acc["reasons"]).when(a["replace"], F.array(a["reason"])).otherwise(F.array_append(acc["reasons"], a["reason"]))
        return F.struct(value.alias("score"), why.alias("reasons"))

    both = both.withColumn("adjusted", F.aggregate("todo", start, adjust))
    place = F.array_position("allowed", F.col("video_id"))
    score = F.when(F.col("listed"), F.greatest(F.col("adjusted.score"), (480 - 20 * (place - 1)).cast("int"))).otherwise(F.col("adjusted.score"))
    remark = F.coalesce(F.nullif("audit_note", F.lit("")), F.lit(R.WHY["listed"]))
    told = F.array_join("adjusted.reasons", "；")
    reason = F.when(~F.col("listed"), told).when(told == "", remark).when(F.contains(told, remark), told).otherwise(F.concat_ws("；", told, remark))
    many = F.when(F.col("q_type").isin(PROJECT, "综合应用题"), SHOWN_LONG).otherwise(SHOWN)
    fallback = F.when(F.col("listed") & (F.size("found") == 0), F.slice("all_parts", F.lit(1), many))
    both = both.withColumns({"score": F.when(F.col("open"), score).otherwise(0), "hit_reason": F.when(F.col("open"), reason).otherwise(""), "chosen": F.coalesce(fallback, F.col("found"))})
    low = F.col("score") < P.LEAST["v5"]
    reject = F.when(low, R.WHY["low"]).when(F.size("chosen") == 0, R.WHY["none_shown"]).otherwise("")
    shown = F.when(~F.col("open"), none).otherwise(F.slice("chosen", F.lit(1), F.when(low, SHOWN_LONG).otherwise(many)))
    return both.withColumns({"reject": reject, "shown": shown, "first_part": F.get("all_parts", F.lit(0)), "isomorph_rank": F.when(F.col("open"), F.col("isomorph_rank")).otherwise(0), "form": F.when(F.col("open"), F.col("form")).otherwise("")})


def reviewed(df: DataFrame) -> DataFrame:
    """Rows of ``details`` with their review: the first case of the decision list that holds, manual branches first."""
    o = lambda f: F.size(f"o_{f}") > 0
    core = o("core") & F.coalesce(F.col("q_type").isin("基本实验题", "科学探究题"), F.lit(False))
    any_ = o("task_model") | o("method") | o("task")
    allow, exclude = F.col("promotion") == "allow", F.col("promotion") == "exclude"
    outside = allow & ~F.array_contains("allowed", F.col("video_id"))
    manual = exclude | outside
    roles = X.join_tags(F.flatten(F.array("o_visual", "o_task_model", "o_task", "o_method", F.when(core, F.col("o_core")).otherwise(F.array().cast("array<string>")))))
    eye = F.when(manual, "否").when(o("visual"), "是").when(any_, "一般").when(allow, "是").otherwise("否")
    pool = F.when(manual, "否").when(allow, "是").when(_allowed() | o("task_model"), "是").otherwise("否")
    told = reduce(lambda a, b: a | b, [F.contains("hit_reason", F.lit(w)) for w in R.SPECIFIC_WORDS])
    specific = F.when(manual, "否").when(allow | told, "是").otherwise("否")
    chapter = F.when(manual, "是").when(allow, "否").when(~(o("visual") | any_ | core), "是").otherwise("否")
    signs = support(o("visual") & (F.col("visual_source") != "无"), o("task_model"), o("method"), (F.col("q_type") == F.col("v_type")) & ~F.col("q_type").isin("基础题", "基础常识选择题"), core)
    note = F.nullif("audit_note", F.lit(""))
    ready = df.withColumns({"first_eye": eye, "same_pool": pool, "specific": specific, "only_chapter": chapter, "roles": F.when(manual, "").otherwise(roles), "support": signs})
    free = ~allow
    cases = [
        (exclude, R.DEMOTE, "excluded"), (outside, R.DEMOTE, "outside"), (F.col("reject") != "", R.DEMOTE, "reject"), (allow & (F.size("shown") == 0), R.REPLACE, "no_part"), (allow, R.KEEP, "allowed"),
        (F.col("choice_filter"), R.DEMOTE, "choice"), (F.col("basic_filter") & ~F.col("allowed_task"), R.DEMOTE, "basic"),
        ((F.col("visual_source") == "无") & F.col("q_type").isin(PROCESS, "科学探究题", PROJECT) & ~F.col("allowed_task"), R.DEMOTE, "no_visual"),
        (F.col("only_chapter") == "是", R.DEMOTE, "chapter"), ((F.col("first_eye") == "否") & ~(o("task_model") | o("method")), R.DEMOTE, "first_eye"),
        ((F.col("q_type") == READING) & (F.col("first_eye") != "是"), R.DEMOTE, "reading"), (F.col("same_pool") == "否", R.DEMOTE, "pool"), (F.col("specific") == "否", R.REPLACE, "vague"),
        (F.size("shown") == 0, R.REPLACE, "no_part"), (free & (F.col("support") < 2) & ~F.col("allowed_task"), R.DEMOTE, "support"),
    ]
    end, why = decide(cases, (R.KEEP, "passed"))
    texts = {
        "excluded": F.coalesce(note, F.lit(R.WHY["excluded"])), "reject": F.col("reject"), "allowed": F.coalesce(note, F.lit(R.WHY["allowed"])),
        "outside": F.concat(F.lit("不在人工白名单："), F.coalesce(F.nullif(X.join_tags(F.array_sort("allowed")), F.lit("")), F.lit("无"))),
    }
    ready = ready.withColumns({"final_review": end, "_why": why})
    words_ = reduce(lambda a, k: a.when(F.col("_why") == k, texts[k] if k in texts else F.lit(R.WHY[k])), [k for k in dict.fromkeys([*[c[2] for c in cases], "passed"])][1:], F.when(F.col("_why") == "excluded", texts["excluded"]))
    return ready.withColumn("review_reason", words_).drop("_why")


OUT = [
    "match_id", "question_id", "paper", "qnum", "primary_type", "video_id", "video_type", "score", "hit_reason", "isomorph_rank", "popsci_form", "screenshot_ids", "screenshot_notes", "reject_reason", "final_show",
    "comparison_only", "first_eye", "same_pool", "specific", "roles", "only_chapter", "basic_filter", "choice_filter", "choice_reason", "visual_source", "false_triggers", "final_review", "review_reason",
]


def _shown(df: DataFrame) -> DataFrame:
    notes = F.transform("shown", lambda p: F.when(p["note"] != "", p["note"]).otherwise(F.left("hit_reason", F.lit(80))))
    return df.withColumns({
        "primary_type": F.col("q_type"), "video_type": F.col("v_type"), "popsci_form": F.col("form"), "screenshot_ids": F.array_join(F.transform("shown", lambda p: p["eid"]), "；"), "screenshot_notes": F.array_join(notes, "；"),
    })


def match_rows(q: DataFrame, v: DataFrame, e: DataFrame, adjustments: DataFrame) -> DataFrame:
    """The match table (columns ``OUT``): the ``BEST`` matches of each question, reviewed and accepted up to its quota; a NO_MATCH
    row for each question without an accepted one; and the rows of the comparison layer, for listed videos that were not
    accepted and have evidence. Ties go to the smaller video id.
    """
    q, v, e = durable(q, "questions"), durable(v, "videos"), durable(e, "evidence")
    # an adjustment may lower a pair out of the best, so as many more candidates are wanted as pairs of one question may be lowered
    lowered = small(adjustments, "the table of adjustments").where("op <> 'max'").groupBy("qnum").agg(F.countDistinct("video_id").alias("n")).agg(F.max("n")).first()[0] or 0
    pairs = candidates(q, v, e, BEST + lowered).unionByName(listed_pairs(q, v, adjustments)).distinct()
    ranked = K.top_k(reviewed(details(pairs, q, v, e, adjustments).where("score > 0")), ["question_id"], [F.desc("score"), F.asc("video_id")], BEST)
    by_type = F.when(F.col("q_type").isin(PROJECT, "综合应用题"), 3).when(F.col("q_type").isin(READING, PROCESS), 2).otherwise(1)
    quota = F.when((F.col("promotion") == "allow") & (F.size("allowed") > 0), F.size("allowed")).otherwise(by_type)
    rows = K.accept(ranked, ["question_id"], [F.desc("score"), F.asc("video_id")], F.col("final_review") == R.KEEP, quota)
    other = F.when(F.col("reject") != "", F.col("reject")).when(F.col("final_review") == R.KEEP, R.WHY["stronger"]).otherwise(F.col("review_reason"))
    rows = durable(_shown(rows).withColumns({"match_id": F.concat_ws("__", "question_id", "video_id"), "final_show": F.col("accepted"), "comparison_only": F.lit(False), "reject_reason": F.when(F.col("accepted"), "").otherwise(other)}).select(OUT), "matches")
    final = rows.where("final_show").select("question_id", "video_id")
    why = F.when(F.col("choice_filter"), R.WHY["choice"]).when(F.col("basic_filter"), R.WHY["basic"]).otherwise(R.WHY["no_match"])
    nothing = {c: F.lit("") for c in ("video_id", "video_type", "hit_reason", "screenshot_ids", "screenshot_notes", "roles", "popsci_form")}
    left = q.join(final.select("question_id").distinct(), "question_id", "left_anti").withColumns(nothing | {
        "match_id": F.concat("question_id", F.lit("__NO_MATCH")), "score": F.lit(0), "isomorph_rank": F.lit(0), "reject_reason": why, "final_show": F.lit(False), "comparison_only": F.lit(False),
        "first_eye": F.lit("否"), "same_pool": F.lit("否"), "specific": F.lit("否"), "only_chapter": F.lit("是"), "final_review": F.lit(R.DEMOTE), "review_reason": why,
    }).select(OUT)
    wanted = q.select("question_id", F.explode("comparison").alias("video_id")).where("video_id <> ''").distinct().join(final, ["question_id", "video_id"], "left_anti")
    compared = details(wanted, q, v, e, adjustments).where(F.col("first_part").isNotNull())
    bare = F.size("shown") == 0
    compared = compared.withColumns({
        "score": F.when(bare, F.greatest("score", F.lit(100))).otherwise(F.col("score")), "hit_reason": F.when(bare & (F.col("hit_reason") == ""), R.WHY["compared_listed"]).otherwise(F.col("hit_reason")),
        "shown": F.when(bare, F.array("first_part")).otherwise(F.col("shown")),
    })
    compared = _shown(compared).withColumns({
        "match_id": F.concat_ws("__", "question_id", "video_id", F.lit("COMPARE")), "reject_reason": F.lit(""), "final_show": F.lit(True), "comparison_only": F.lit(True), "first_eye": F.lit("一般"), "same_pool": F.lit("是"),
        "specific": F.lit("是"), "roles": F.lit(""), "only_chapter": F.lit("否"), "final_review": F.lit(R.KEEP), "review_reason": F.coalesce(F.nullif("audit_note", F.lit("")), F.lit(R.WHY["compared"])),
    }).select(OUT)
    return rows.unionByName(left).unionByName(compared)
