"""Queries over single texts: cleaning, tokens, tags by rules, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.functions import text as X
from sievemark.functions.rules import has_any, tags  # noqa: F401
from sievemark.operators import labels as L
from sievemark.plans import rule_tables as R
from sievemark.queries import Registry
from sievemark.queries import base as B
from sievemark.session import table

REG = Registry()
_NO_WORD = "[^A-Za-z0-9_一-龥-]+"


@REG.add("normalize_text", f"SELECT doc_id, {B.sql_normalize('text')} AS norm_text FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.normalize(F.col("text")).alias("norm_text"))


@REG.add("strip_spaces", f"SELECT doc_id, {B.sql_compact('text')} AS compact_text FROM documents")
def strip_spaces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.compact(F.col("text")).alias("compact_text"))


@REG.add("clean_stem", f"WITH {B.Q} SELECT question_id, {B.sql_clean('stem')} AS stem FROM q")
def clean_stem(spark: SparkSession, d: str) -> DataFrame:
    return B.questions(spark, d, "stem").select("question_id", X.clean_stem(F.col("stem")).alias("stem"))


@REG.add("slug", f"WITH {B.Q} SELECT DISTINCT paper, regexp_replace(regexp_replace(paper, '{_NO_WORD}', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM q")
def slug(spark: SparkSession, d: str) -> DataFrame:
    return B.questions(spark, d, "paper").select("paper", X.slug(F.col("paper")).alias("slug")).distinct()


@REG.add("paper_link", f"WITH {B.Q} SELECT DISTINCT paper, url_encode(replace(paper, '（', '_')) AS link FROM q")
def paper_link(spark: SparkSession, d: str) -> DataFrame:
    link = F.replace(F.url_encode(F.replace(F.col("paper"), F.lit("（"), F.lit("_"))), F.lit("+"), F.lit("%20"))
    return B.questions(spark, d, "paper").select("paper", link.alias("link")).distinct()


@REG.add("short_text", f"SELECT doc_id, CASE WHEN length(n) <= 180 THEN n ELSE n[1:179] || '…' END AS short_text FROM (SELECT doc_id, {B.sql_normalize('text')} AS n FROM documents)")
def short_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.short(F.col("text")).alias("short_text"))




def _sql_words(x: str) -> str:
    return f"list_distinct(regexp_extract_all(coalesce({x}, ''), '{X.WORD}'))"


_SQL_STOP = "[" + ", ".join(B.sql_quote(w) for w in X.STOP_WORDS) + "]"


@REG.add("keyword_tokens", f"WITH {B.Q}, w AS (SELECT question_id, unnest({_sql_words('stem')}) AS token FROM q) SELECT question_id, token FROM w WHERE NOT list_contains({_SQL_STOP}, token)")
def keyword_tokens(spark: SparkSession, d: str) -> DataFrame:
    return B.questions(spark, d, "stem").select("question_id", F.explode(X.keywords(F.col("stem"))).alias("token"))


@REG.add("token_counts", f"SELECT token, count(*) AS n_documents FROM (SELECT unnest({_sql_words(B.sql_normalize('text'))}) AS token FROM documents) GROUP BY token")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(X.tokens(X.normalize(F.col("text")))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n_documents"))


@REG.add(
    "split_join_tags",
    f"""WITH {B.Q}, s AS (SELECT question_id, regexp_split_to_array(coalesce(knowledge_tags, ''), '[、；;，,/ ]+') AS a FROM q)
    SELECT question_id, array_to_string(list_filter(a, lambda z, i: z <> '' AND list_position(a, z) = i), '、') AS tags,
           CAST(len(list_distinct(list_filter(a, lambda z: z <> ''))) AS INT) AS n_tags FROM s""",
)
def split_join_tags(spark: SparkSession, d: str) -> DataFrame:
    t = X.split_tags(F.col("knowledge_tags"))
    return B.questions(spark, d, "knowledge_tags").select("question_id", X.join_tags(t).alias("tags"), F.size(t).alias("n_tags"))


@REG.add(
    "tag_set_ops",
    f"""WITH {B.Q}, s AS (SELECT question_id, {B.sql_split('method_skeleton')} AS a, {B.sql_split('signatures')} AS b FROM q)
    SELECT question_id, CAST(len(list_intersect(a, b)) AS INT) AS n_shared, CAST(len(list_distinct(list_concat(a, b))) AS INT) AS n_union,
      CAST(len(list_filter(a, lambda z: NOT list_contains(b, z))) AS INT) AS n_only_left,
      CASE WHEN len(list_concat(a, b)) = 0 THEN 0.0 ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) END AS jaccard FROM s""",
)
def tag_set_ops(spark: SparkSession, d: str) -> DataFrame:
    q = B.questions(spark, d, "method_skeleton", "signatures").select("question_id", X.split_tags(F.col("method_skeleton")).alias("a"), X.split_tags(F.col("signatures")).alias("b"))
    shared, union = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    jaccard = F.when(union == 0, 0.0).otherwise(shared / union)
    return q.select("question_id", shared.alias("n_shared"), union.alias("n_union"), F.size(F.array_except("a", "b")).alias("n_only_left"), jaccard.alias("jaccard"))


@REG.add(
    "first_filled",
    f"""WITH {B.V} SELECT video_id, coalesce(nullif(trim(question_type), ''), nullif(trim(method_skeleton), ''), nullif(trim(hierarchy), ''), '') AS label,
    concat_ws(' - ', nullif(trim(source), ''), nullif(trim(hierarchy), ''), nullif(trim(question_type), '')) AS path FROM v""",
)
def first_filled(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    v = B.videos(spark, d, "source", "hierarchy", "question_type", "method_skeleton")
    return v.select("video_id", X.first_filled(c("question_type"), c("method_skeleton"), c("hierarchy")).alias("label"), X.join_filled(" - ", c("source"), c("hierarchy"), c("question_type")).alias("path"))


_SQL_KEY = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\.[A-Za-z0-9]+$', ''), '【[^】]*(?:脚本|录音|定稿|终版|逐字稿|解题)[^】]*】', '', 'g'), '[\[\]（）()【】《》_+ \x{{3000}}·•\-—]+', '', 'g'), '(?:脚本|录音稿|逐字稿|定稿|终版|最终稿|不含批注|含题干|解题课|录屏课|新版|新修|副本|复制|[vV][0-9]+)', '', 'g')"


@REG.add("transcript_name_key", f"WITH {B.T} SELECT transcript_id, {B.sql_compact(_SQL_KEY.format(x='file_name'))} AS name_key FROM t")
def transcript_name_key(spark: SparkSession, d: str) -> DataFrame:
    return B.transcripts(spark, d, "file_name").select("transcript_id", X.name_key(F.col("file_name")).alias("name_key"))


@REG.add(
    "evidence_text",
    f"""WITH {B.V}, {B.T} SELECT video_id,
      CASE WHEN t.transcript_id IS NULL THEN coalesce(v.content_summary, '')[1:1200]
      ELSE {B.sql_normalize("concat_ws('；', coalesce(t.summary, ''), n.norm[1:1600], coalesce(v.content_summary, ''))")}[1:2200] END AS evidence
    FROM v LEFT JOIN t ON t.transcript_id = v.transcript_id LEFT JOIN (SELECT transcript_id, {B.sql_normalize('text')} AS norm FROM t) n ON n.transcript_id = t.transcript_id""",
)
def evidence_text(spark: SparkSession, d: str) -> DataFrame:
    t = B.transcripts(spark, d, "summary", "text").select("transcript_id", "summary", F.left(X.normalize(F.col("text")), F.lit(1600)).alias("body"), F.lit(True).alias("there"))
    v = B.videos(spark, d, "transcript_id", "content_summary").join(t, "transcript_id", "left")
    whole = F.left(X.normalize(F.concat_ws("；", X.text(F.col("summary")), F.col("body"), X.text(F.col("content_summary")))), F.lit(2200))
    return v.select("video_id", F.when(F.col("there"), whole).otherwise(F.left(X.text(F.col("content_summary")), F.lit(1200))).alias("evidence"))


@REG.add(
    "block_number",
    f"""WITH {B.Q}, b AS (SELECT question_id, CASE WHEN qnum % 3 = 0 THEN '（多选）' || qnum || '．' WHEN qnum % 3 = 1 THEN qnum || '、' ELSE '第' || qnum || '题 ' END || stem AS t FROM q)
    SELECT question_id, CASE WHEN n BETWEEN 1 AND 40 THEN n END AS n FROM (SELECT question_id,
      CAST(coalesce(nullif(regexp_extract(t, '^([0-9]{{1,2}})[．.、]', 1), ''), nullif(regexp_extract(t, '^[（(]多选[）)]\\s*([0-9]{{1,2}})[．.、]', 1), '')) AS INT) AS n FROM b)""",
)
def block_number(spark: SparkSession, d: str) -> DataFrame:
    n, s = F.col("qnum"), F.col("stem")
    block = F.when(n % 3 == 0, F.concat(F.lit("（多选）"), n, F.lit("．"), s)).when(n % 3 == 1, F.concat(n, F.lit("、"), s)).otherwise(F.concat(F.lit("第"), n, F.lit("题 "), s))
    return B.questions(spark, d, "qnum", "stem").select("question_id", X.block_number(block).alias("n"))


@REG.add(
    "escape_cells",
    f"""WITH {B.V} SELECT video_id, '<td>' || replace(replace(replace(replace(coalesce(content_summary, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</td>' AS cell FROM v""",
)
def escape_cells(spark: SparkSession, d: str) -> DataFrame:
    return B.videos(spark, d, "content_summary").select("video_id", F.concat(F.lit("<td>"), X.escape(F.col("content_summary")), F.lit("</td>")).alias("cell"))


_SQL_PAIRS = f"""WITH {B.V}, s AS (SELECT video_id, unnest(regexp_extract_all(coalesce(screenshot_refs, ''), '[A-Z]+:[^；;、，,\\s]+')) AS p FROM v),
  k AS (SELECT video_id, split_part(p, ':', 1) AS col, split_part(p, ':', 2) AS label FROM s)"""


@REG.add(
    "screenshot_columns",
    _SQL_PAIRS + """ SELECT video_id, col, label, CAST(CASE length(col) WHEN 1 THEN ascii(col) - 64 ELSE (ascii(col[1]) - 64) * 26 + ascii(col[2]) - 64 END AS INT) AS col_number, col AS col_again FROM k""",
)
def screenshot_columns(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.explode(F.regexp_extract_all(X.text(F.col("screenshot_refs")), F.lit(r"[A-Z]+:[^；;、，,\s]+"), F.lit(0)))
    k = B.videos(spark, d, "screenshot_refs").select("video_id", pairs.alias("p")).select("video_id", F.split_part("p", F.lit(":"), F.lit(1)).alias("col"), F.split_part("p", F.lit(":"), F.lit(2)).alias("label"))
    number = X.column_number(F.col("col"))
    return k.select("video_id", "col", "label", number.alias("col_number"), X.column_letters(number).alias("col_again"))


@REG.add("topic_tags", f"WITH {B.Q} SELECT question_id, {B.sql_cell(B.sql_tags(R.TOPICS, 'coalesce(stem, chr(0))', 'stem'))} AS topics FROM q")
def topic_tags(spark: SparkSession, d: str) -> DataFrame:
    return B.questions(spark, d, "stem").select("question_id", X.join_tags(tags(R.TOPICS, F.col("stem"))).alias("topics"))


_FAMILIES = {"visual": R.VISUAL, "background": R.BACKGROUND, "task": R.TASKS, "task_model": R.TASK_MODELS, "method": R.METHODS, "core": R.CORE}


def sql_families(source: str, key: str, stem: str) -> str:
    """CTEs: ``{source}_f`` with the key and one list per family."""
    lists = []
    for n, rules in _FAMILIES.items():
        found = B.sql_tags(rules, "r", "p")
        drop = ", ".join(B.sql_quote(x) for x in R.PROCESS_TAGS.get(n, []))
        lists.append(f"CASE WHEN {B.sql_has_any('r', 'p', R.PROCESS_CONTEXT)} THEN {found} ELSE list_filter({found}, lambda z: NOT list_contains([{drop}], z)) END AS {n}" if drop else f"{found} AS {n}")
    return f"{source}_c AS (SELECT {key}, {B.sql_clean(stem)} AS r, {B.sql_compact(B.sql_clean(stem))} AS p FROM {source}), {source}_f AS (SELECT {key}, {', '.join(lists)} FROM {source}_c)"


@REG.add(
    "tags_by_rules",
    f"WITH {B.Q}, {sql_families('q', 'question_id', 'stem')} SELECT question_id, " + ", ".join(f"array_to_string({n}, '、') AS {n}_tags" for n in _FAMILIES) + " FROM q_f",
)
def tags_by_rules(spark: SparkSession, d: str) -> DataFrame:
    q = L.with_families(B.questions(spark, d, "stem"), "stem")
    return q.select("question_id", *[X.join_tags(F.col(n)).alias(f"{n}_tags") for n in L.FAMILIES])


@REG.add(
    "labels_by_family",
    f"WITH {B.V}, {sql_families('v', 'video_id', 'content_summary')}, x AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS family, unnest({n}) AS tag FROM v_f" for n in _FAMILIES)
    + ") SELECT family, tag, count(*) AS n_videos FROM x GROUP BY 1, 2",
)
def labels_by_family(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("family"), F.col(n).alias("tags")) for n in L.FAMILIES]))
    rows = L.with_families(B.videos(spark, d, "content_summary"), "content_summary").select(kinds.alias("f")).select("f.family", F.explode("f.tags").alias("tag"))
    return rows.groupBy("family", "tag").agg(F.count(F.lit(1)).alias("n_videos"))


@REG.add(
    "false_trigger_keywords",
    f"""WITH {B.Q}, c AS (SELECT question_id, {B.sql_compact('stem')} AS p FROM q)
    SELECT question_id, array_to_string(list_filter([{', '.join(B.sql_quote(k) for k in R.FALSE_TRIGGERS)}], lambda k: contains(p, k)), '、') AS hits FROM c""",
)
def false_trigger_keywords(spark: SparkSession, d: str) -> DataFrame:
    packed = X.compact(F.col("stem"))
    hits = F.filter(F.array(*map(F.lit, R.FALSE_TRIGGERS)), lambda k: packed.contains(k))
    return B.questions(spark, d, "stem").select("question_id", F.array_join(hits, "、").alias("hits"))


_SQL_SIGNATURES = f"s AS (SELECT question_id, list_distinct_in_order(f) AS sig FROM (SELECT question_id, {B.sql_tags(R.SIGNATURES, 'r', 'p')} AS f FROM (SELECT question_id, coalesce(stem, '') AS r, {B.sql_compact('stem')} AS p FROM q)))".replace(
    "list_distinct_in_order(f)", "list_filter(f, lambda z, i: list_position(f, z) = i)"
)
_SQL_LOOKUP = "lookup(ord, signature, knowledge, problem, method) AS (VALUES " + ", ".join(
    f"({i}, {B.sql_quote(n)}, [{', '.join(map(B.sql_quote, k))}], [{', '.join(map(B.sql_quote, p))}], {B.sql_quote(m)})" for i, (n, k, p, m) in enumerate(R.SIGNATURE_TAGS)
) + ")"


@REG.add("signatures", f"WITH {B.Q}, {_SQL_SIGNATURES} SELECT question_id, array_to_string(sig, '、') AS signatures, CAST(len(sig) AS INT) AS n_signatures FROM s")
def signatures(spark: SparkSession, d: str) -> DataFrame:
    q = L.prepare(B.questions(spark, d, "stem"), "stem").withColumn("found", tags(R.SIGNATURES, F.col("_raw"), F.col("_packed")))
    return q.select("question_id", X.join_tags(F.col("found")).alias("signatures"), F.size("found").alias("n_signatures"))


@REG.add(
    "signature_lookup",
    f"""WITH {B.Q}, {_SQL_SIGNATURES}, {_SQL_LOOKUP}, j AS (SELECT question_id, ord, knowledge, problem, method FROM (SELECT question_id, unnest(sig) AS signature FROM s) JOIN lookup USING (signature)),
    g AS (SELECT question_id, flatten(list(knowledge ORDER BY ord)) AS k, flatten(list(problem ORDER BY ord)) AS p, list(method ORDER BY ord) AS m FROM j GROUP BY 1)
    SELECT question_id, array_to_string(list_filter(k, lambda z, i: list_position(k, z) = i), '、') AS knowledge, array_to_string(list_filter(p, lambda z, i: list_position(p, z) = i), '、') AS problem,
      array_to_string(list_filter(m, lambda z, i: list_position(m, z) = i), '、') AS method FROM g""",
)
def signature_lookup(spark: SparkSession, d: str) -> DataFrame:
    lookup = spark.createDataFrame([(i, *row) for i, row in enumerate(R.SIGNATURE_TAGS)], "ord int, signature string, knowledge array<string>, problem array<string>, method string")
    q = L.prepare(B.questions(spark, d, "stem"), "stem").withColumn("found", tags(R.SIGNATURES, F.col("_raw"), F.col("_packed")))
    hits = q.select("question_id", F.explode("found").alias("signature"))
    g = hits.join(F.broadcast(lookup), "signature").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("ord", "knowledge", "problem", "method"))).alias("g"))
    return g.select("question_id", X.join_tags(F.flatten("g.knowledge")).alias("knowledge"), X.join_tags(F.flatten("g.problem")).alias("problem"), X.join_tags(F.col("g.method")).alias("method"))


def _sql_type(generation: str = "v5") -> str:
    return B.sql_first_case(R.TYPE_CASES[generation], "r", "p", "'基础题'")


_SQL_COMPOSITE = ", ".join(B.sql_quote(t) for t in R.COMPOSITE_TYPES)
_SQL_STEM = f"c AS (SELECT question_id, has_visual, score, raw_qtype, coalesce(stem, '') AS r, {B.sql_compact('stem')} AS p FROM q)"
_SQL_HARD = B.sql_has_any("r", "p", R.HARD_WORDS)


@REG.add(
    "type_cascade",
    f"""WITH {B.Q}, {_SQL_STEM} SELECT question_id, ty AS question_type, CASE WHEN hard THEN 4 WHEN ty IN ({_SQL_COMPOSITE}) THEN 3 ELSE 1 END AS difficulty,
    CASE WHEN has_visual THEN 'PDF题图' WHEN prompt THEN '题干明确图表词' ELSE '无' END AS evidence_source
    FROM (SELECT question_id, has_visual, {_sql_type()} AS ty, ({_SQL_HARD} OR length(r) > 700) AS hard, {B.sql_has_any('r', 'p', R.PROMPT_WORDS)} AS prompt FROM c)""",
)
def type_cascade(spark: SparkSession, d: str) -> DataFrame:
    q = L.prepare(B.questions(spark, d, "stem", "has_visual"), "stem").withColumn("question_type", L.question_type())
    return q.select("question_id", "question_type", L.difficulty(F.col("question_type")).alias("difficulty"), L.evidence_source(F.col("has_visual")).alias("evidence_source"))


@REG.add(
    "choice_filter",
    f"""WITH {B.Q}, {_SQL_STEM} SELECT question_id, choice AND NOT graph AND NOT prompt AS left_out,
    CASE WHEN NOT choice THEN '非选择题' WHEN graph THEN '坐标图像选择题' WHEN prompt THEN '题干有图表' ELSE '' END AS reason
    FROM (SELECT question_id, contains(coalesce(raw_qtype, ''), '选择') AND coalesce(score, 0) <= 4 AS choice, {B.sql_has_any('r', 'p', ["坐标图", "坐标曲线", "变化曲线", "纵坐标", "横坐标", "随时间变化"])} AS graph,
      {B.sql_has_any('r', 'p', R.PROMPT_WORDS)} AS prompt FROM c)""",
)
def choice_filter(spark: SparkSession, d: str) -> DataFrame:
    raw, packed = F.col("_raw"), F.col("_packed")
    choice = X.text(F.col("raw_qtype")).contains("选择") & (F.coalesce("score", F.lit(0)) <= 4)
    graph = has_any(raw, ["坐标图", "坐标曲线", "变化曲线", "纵坐标", "横坐标", "随时间变化"], packed)
    q = L.prepare(B.questions(spark, d, "stem", "raw_qtype", "score"), "stem").withColumns({"choice": choice, "graph": graph, "prompt": has_any(raw, R.PROMPT_WORDS, packed)})
    reason = F.when(~F.col("choice"), "非选择题").when(F.col("graph"), "坐标图像选择题").when(F.col("prompt"), "题干有图表").otherwise("")
    return q.select("question_id", (F.col("choice") & ~F.col("graph") & ~F.col("prompt")).alias("left_out"), reason.alias("reason"))


# two questions glued into one: the tables have none, so the tenth of each paper gets what an eleventh would read like, and every
# second paper loses its own eleventh
_GLUED = (" （多选）11．", " 12．")


@REG.add(
    "merged_stem_split",
    f"""WITH {B.Q}, src AS (SELECT question_id, paper, qnum, question_type, raw_qtype, CASE WHEN qnum = 10 THEN coalesce(stem, '') || '{_GLUED[0]}' || coalesce(raw_qtype, '') || '的题干{_GLUED[1]}余下' ELSE coalesce(stem, '') END AS stem
      FROM q WHERE paper IS NOT NULL AND NOT (qnum = 11 AND length(paper) % 2 = 0)),
    has AS (SELECT DISTINCT paper FROM src WHERE qnum = 11), m AS (SELECT *, qnum = 10 AND paper NOT IN (SELECT paper FROM has) AND regexp_extract(stem, '[（(]?多选[）)]?\\s*([0-9]{{1,2}})[．.、]', 1) = '11' AS cut,
      strpos(stem, regexp_extract(stem, '[（(]?多选[）)]?\\s*[0-9]{{1,2}}[．.、]')) AS place FROM src)
    SELECT question_id, qnum, question_type, raw_qtype, CASE WHEN cut THEN {B.sql_clean('stem[1:place - 1]')} ELSE stem END AS stem FROM m
    UNION ALL SELECT replace(question_id, '-Q10', '-Q11'), 11, '选择题图像题', '选择题', {B.sql_clean("regexp_replace(stem[place:], '\\s*1[2-9][．.、](?s:.*)$', '')")} FROM m WHERE cut""",
)
def merged_stem_split(spark: SparkSession, d: str) -> DataFrame:
    """A tenth question that holds a multi-select eleventh, where the paper has none of its own, becomes two."""
    q = B.questions(spark, d, "paper", "qnum", "stem", "question_type", "raw_qtype").where(F.col("paper").isNotNull() & ~F.coalesce((F.col("qnum") == 11) & (F.length("paper") % 2 == 0), F.lit(False)))
    glued = F.concat(X.text(F.col("stem")), F.lit(_GLUED[0]), X.text(F.col("raw_qtype")), F.lit("的题干" + _GLUED[1] + "余下"))
    return L.split_merged(q.withColumn("stem", F.when(F.col("qnum") == 10, glued).otherwise(X.text(F.col("stem"))))).select("question_id", "qnum", "question_type", "raw_qtype", "stem")


@REG.add(
    "type_cascades",
    f"""WITH {B.Q}, c AS (SELECT question_id, coalesce(stem, '') AS r0, {B.sql_compact('stem')} AS p0, {B.sql_clean('stem')} AS r1, {B.sql_compact(B.sql_clean('stem'))} AS p1 FROM q)
    SELECT question_id, {B.sql_first_case(R.TYPE_CASES['g3'], 'p0', 'p0', "'基础题'")} AS type_g3, {", ".join(B.sql_first_case(R.TYPE_CASES[g], 'r1', 'p1', "'基础题'") + f' AS type_{g}' for g in ('v3', 'v4', 'v5'))} FROM c""",
)
def type_cascades(spark: SparkSession, d: str) -> DataFrame:
    """The type of each question by the cascades of four generations."""
    q = B.questions(spark, d, "stem").withColumn("_raw", X.compact(F.col("stem"))).withColumn("_packed", F.col("_raw"))
    q = q.withColumn("type_g3", L.question_type(generation="g3"))
    q = L.prepare(q, "stem", clean=True)
    return q.select("question_id", "type_g3", *[L.question_type(generation=g).alias(f"type_{g}") for g in ("v3", "v4", "v5")])


@REG.add(
    "label_visibility",
    f"WITH {B.Q}, {sql_families('q', 'question_id', 'stem')} SELECT question_id, CASE WHEN len(visual) > 0 THEN '截图一眼像' WHEN len(method) > 0 OR len(core) > 0 THEN '需文字解释' ELSE '只适合过程库' END AS visibility FROM q_f",
)
def label_visibility(spark: SparkSession, d: str) -> DataFrame:
    return L.with_families(B.questions(spark, d, "stem"), "stem").select("question_id", L.visibility().alias("visibility"))


_SQL_TOPICS_OF = B.sql_tags(R.TOPICS, "r", "p")
_SQL_NAMES = lambda names: "[" + ", ".join(names) + "]"


@REG.add(
    "tags_for_text",
    f"""WITH {B.Q}, {_SQL_SIGNATURES}, {_SQL_LOOKUP}, c AS (SELECT question_id, coalesce(stem, '') AS r, {B.sql_compact('stem')} AS p FROM q),
    j AS (SELECT question_id, flatten(list(knowledge ORDER BY ord)) AS k, flatten(list(problem ORDER BY ord)) AS pr, list(method ORDER BY ord) AS me FROM (SELECT question_id, unnest(sig) AS signature FROM s) JOIN lookup USING (signature) GROUP BY 1),
    x AS (SELECT c.question_id, r, p, sig, list_concat(coalesce(k, []), {_SQL_TOPICS_OF}) AS k, coalesce(pr, []) AS pr, coalesce(me, []) AS me FROM c JOIN s USING (question_id) LEFT JOIN j USING (question_id)),
    t AS (SELECT *, {B.sql_first_case(R.TYPE_CASES['g3'], 'p', 'p', "CASE WHEN len(list_distinct(k)) >= 3 THEN '综合应用题' ELSE '基础题' END")} AS ty FROM x),
    o AS (SELECT question_id, ty, sig, k, CASE WHEN len(pr) > 0 THEN pr ELSE [CASE ty {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in R.TYPE_PROBLEMS.items())} ELSE '{R.OTHER_PROBLEM}' END] END AS pr,
      CASE WHEN len(me) > 0 THEN me WHEN ty IN {R.KNOWLEDGE_TYPES} THEN ['{R.KNOWLEDGE_FIRST}'] ELSE ['{R.PROBLEM_FIRST}'] END AS me,
      CASE WHEN {B.sql_has_any('p', 'p', R.HARD_WORDS)} OR length(r) > 700 THEN 4 WHEN ty IN ({_SQL_COMPOSITE}) THEN 3 ELSE 1 END AS difficulty,
      list_concat(sig[1:3], list_filter([{", ".join(f"CASE WHEN {B.sql_has_any('p', 'p', k)} THEN '{n}' END" for n, k in R.CONSTRAINTS)}], lambda z: z IS NOT NULL)) AS co FROM t)
    SELECT question_id, ty AS question_type, coalesce(nullif({B.sql_cell('k')}, ''), '{R.NO_KNOWLEDGE}') AS knowledge_tags, {B.sql_cell('pr')} AS problem_tags, difficulty, {B.sql_cell('me')} AS method_skeleton,
      coalesce(nullif({B.sql_cell('co')}, ''), '{R.NO_CONSTRAINT}') AS key_constraints, {B.sql_cell('sig')} AS signatures FROM o""",
)
def tags_for_text(spark: SparkSession, d: str) -> DataFrame:
    """All labels that the third generation gives a text: by signature where there is one, else by type."""
    return L.tags_for_text(B.questions(spark, d, "stem"), "question_id", "stem")


@REG.add(
    "intake_tags",
    f"""WITH {B.Q}, {_SQL_STEM} SELECT question_id, ty AS question_type, CASE WHEN hard THEN 4 WHEN ty IN ({_SQL_COMPOSITE}) THEN 3 ELSE 1 END AS difficulty
    FROM (SELECT question_id, {_sql_type()} AS ty, ({_SQL_HARD} OR length(r) > 700) AS hard FROM c)""",
)
def intake_tags(spark: SparkSession, d: str) -> DataFrame:
    """The same labels as a stream: the table is read as arriving files, tagged and written, and the result read back."""
    import uuid

    from sievemark.session import shared_dir
    from sievemark.streaming import intake

    base = f"{shared_dir(spark)}/intake-{uuid.uuid4().hex}"
    q = B.questions(spark, d, "paper", "stem", "has_visual").select("question_id", "paper", "stem", "has_visual", F.col("imported_at").cast("timestamp").alias("imported_at"))
    q.write.parquet(f"{base}/in")
    intake.start(intake.tagged(intake.read_stream(spark, f"{base}/in")), f"{base}/out", f"{base}/log").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("question_id", "question_type", "difficulty")
