"""Queries that turn matches into what is delivered: coverage, layout, summaries, sections, sheets."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemark.functions import text as X
from sievemark.operators import ranking as K
from sievemark.operators import sequences as S
from sievemark.queries import Registry
from sievemark.queries import base as B
from sievemark.queries import gated as G
from sievemark.queries import matching as M
from sievemark.session import durable, shared_dir
from sievemark.sources import documents as D
from sievemark.sources import overrides as O
from sievemark.sources import sheets

REG = Registry()

# --- coverage -------------------------------------------------------------------------------------


def _coverage(q: DataFrame, hit: DataFrame) -> DataFrame:
    """Per paper: questions, those in ``hit`` (question ids), points of all and of these. A null score counts as none."""
    both = q.join(hit.select("question_id").distinct().withColumn("_hit", F.lit(True)), "question_id", "left")
    points = F.coalesce("score", F.lit(0))
    return both.groupBy("paper").agg(
        F.count(F.lit(1)).alias("n_questions"), F.count("_hit").alias("n_hits"), F.sum(points).alias("points"), F.coalesce(F.sum(F.when(F.col("_hit"), points)), F.lit(0)).alias("points_hit")
    )


def _sql_coverage(hit: str) -> str:
    return f"""SELECT paper, count(*) AS n_questions, count(*) FILTER (question_id IN ({hit})) AS n_hits, CAST(sum(coalesce(score, 0)) AS BIGINT) AS points,
    CAST(coalesce(sum(coalesce(score, 0)) FILTER (question_id IN ({hit})), 0) AS BIGINT) AS points_hit FROM q GROUP BY paper"""


@REG.add("coverage_audit", f"WITH {M._SQL_KEPT} " + _sql_coverage("SELECT question_id FROM kept WHERE final_show"))
def coverage_audit(spark: SparkSession, d: str) -> DataFrame:
    """Coverage by the third generation: final matches only."""
    return _coverage(B.questions(spark, d, "paper", "score"), M._with_final(spark, d))


@REG.add("coverage_final", f"WITH {G._SQL_MATCHES} " + _sql_coverage("SELECT question_id FROM table_ WHERE final_show AND NOT comparison_only"))
def coverage_final(spark: SparkSession, d: str) -> DataFrame:
    """Coverage by the fifth generation: final matches, those for comparison only don't count."""
    return _coverage(B.questions(spark, d, "paper", "score"), G._matches(spark, d).where("final_show AND NOT comparison_only"))


@REG.add(
    "not_false",
    f"WITH {B.Q}, f AS (SELECT question_id, CASE WHEN score IS NULL THEN NULL ELSE score > 2 END AS shown FROM q) SELECT question_id, shown FROM f WHERE shown IS DISTINCT FROM false",
)
def not_false(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose flag isn't false: null is not false."""
    f = B.questions(spark, d, "score").select("question_id", (F.col("score") > 2).alias("shown"))
    return f.where(~F.col("shown").eqNullSafe(F.lit(False)))


# --- analysis rows and layout of the final table -----------------------------------------------------

_FOCUS = ("core", "task_model", "method", "background", "visual")


def _first(c: str) -> Column:
    """The first value of a cell as a reader takes it: up to the first enumeration comma; null for an empty cell."""
    return F.when(X.text(F.col(c)) != "", F.split_part(F.col(c), F.lit("、"), F.lit(1)))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    raw = B.questions(spark, d, "score", "problem_tags", "knowledge_tags").select("question_id", "score", "problem_tags", "knowledge_tags")
    group = F.when(F.contains(F.coalesce("paper", F.lit("")), F.lit(G._GROUP[0])) & F.col("qnum").between(*G._GROUP[1:]), f"Q{G._GROUP[1]}-Q{G._GROUP[2]}")
    return G._exams(spark, d).withColumn("topic_group", group).join(raw, "question_id")


_SQL_FOCUS = {t: f"CASE WHEN coalesce({t}, '') <> '' THEN split_part({t}, '、', 1) END" for t in ("problem_tags", "knowledge_tags")}
_SQL_TAG = ", ".join(f"x.{f}[1]" for f in _FOCUS)
_SQL_LABELLED = f"""lb AS (SELECT x.*, q.score, {_SQL_FOCUS['problem_tags'].replace('problem_tags', 'q.problem_tags')} AS f1, {_SQL_FOCUS['knowledge_tags'].replace('knowledge_tags', 'q.knowledge_tags')} AS f2, coalesce({_SQL_TAG}) AS f3,
    CASE WHEN contains(coalesce(x.paper, ''), '{G._GROUP[0]}') AND x.qnum BETWEEN {G._GROUP[1]} AND {G._GROUP[2]} THEN 'Q{G._GROUP[1]}-Q{G._GROUP[2]}' END AS topic_group FROM ex x JOIN q USING (question_id))"""


@REG.add(
    "final_analysis",
    f"""WITH {G._SQL_MATCHES}, {_SQL_LABELLED},
    pm AS (SELECT t.question_id, v.video_name, t.score, row_number() OVER (PARTITION BY t.question_id ORDER BY list_position(lb.allowed, t.video_id) NULLS LAST, t.isomorph_rank DESC, t.score DESC, t.video_id) AS n FROM table_ t JOIN v USING (video_id) JOIN lb ON lb.question_id = t.question_id WHERE final_show AND NOT comparison_only),
    g AS (SELECT question_id, string_agg(coalesce(video_name, ''), '；' ORDER BY n) FILTER (n <= 3) AS names, arg_min(score, n) AS first_score FROM pm GROUP BY 1)
    SELECT question_id, primary_type, coalesce(topic_group, CAST(qnum AS VARCHAR), '') AS number, CASE WHEN score <> 0 THEN CAST(score AS VARCHAR) ELSE '' END AS points, primary_type || '——' || coalesce(f1, f2, f3, '综合考查') AS anchor,
      CASE WHEN names IS NOT NULL THEN '✅' WHEN choice_filter OR basic_filter THEN '—' ELSE '❌' END AS status, coalesce(names, CASE WHEN choice_filter OR basic_filter THEN '基础题未进宣传版' ELSE '无对应解题课' END) AS videos,
      coalesce(f1, f2, f3, primary_type) || '，' || CASE WHEN score <> 0 THEN CAST(score AS VARCHAR) || '分，' ELSE '' END || CASE WHEN first_score < 130 THEN '讲了！' ELSE '命中！' END AS summary FROM lb LEFT JOIN g USING (question_id)""",
)
def final_analysis(spark: SparkSession, d: str) -> DataFrame:
    """The analysis row of each question: type, group or number, points, what it is about, status, three names, summary."""
    q = _labelled(spark, d)
    names = B.videos(spark, d, "video_name").select("video_id", "video_name")
    promo = G._matches(spark, d).where("final_show AND NOT comparison_only").select("question_id", "video_id", F.col("score").alias("s"), "isomorph_rank").join(names, "video_id").join(q.select("question_id", "allowed"), "question_id")
    place = F.nullif(F.array_position("allowed", F.col("video_id")), F.lit(0))
    ordered = K.numbered(promo.withColumn("place", place), ["question_id"], [F.asc_nulls_last("place"), F.desc("isomorph_rank"), F.desc("s"), F.asc("video_id")], "n")
    three = F.array_sort(F.collect_list(F.when(F.col("n") <= 3, F.struct("n", X.text(F.col("video_name")).alias("name")))))
    g = ordered.groupBy("question_id").agg(F.array_join(three["name"], "；").alias("names"), F.min(F.struct("n", "s")).alias("top"))
    both = q.join(g, "question_id", "left")
    tag = F.coalesce(*[F.get(F.col(f), F.lit(0)) for f in _FOCUS])
    focus = F.coalesce(_first("problem_tags"), _first("knowledge_tags"), tag)
    points = F.when(F.col("score") != 0, F.col("score").cast("string")).otherwise("")
    out = F.col("choice_filter") | F.col("basic_filter")
    return both.select(
        "question_id", "primary_type", F.coalesce("topic_group", F.col("qnum").cast("string"), F.lit("")).alias("number"), points.alias("points"), F.concat("primary_type", F.lit("——"), F.coalesce(focus, F.lit("综合考查"))).alias("anchor"),
        F.when(F.col("names").isNotNull(), "✅").when(out, "—").otherwise("❌").alias("status"), F.coalesce("names", F.when(out, "基础题未进宣传版").otherwise("无对应解题课")).alias("videos"),
        F.concat(F.coalesce(focus, F.col("primary_type")), F.lit("，"), F.when(points != "", F.concat(points, F.lit("分，"))).otherwise(""), F.when(F.col("top.s") < 130, "讲了！").otherwise("命中！")).alias("summary"),
    )


#: Videos shown beside a question, and images over all of them.
SHOWN_VIDEOS, SHOWN_IMAGES = 6, 6
_SQL_PLACE = "CASE WHEN list_contains(o, t.video_id) THEN list_position(o, t.video_id) - 1 ELSE 950 END"


@REG.add(
    "final_layout",
    f"""WITH {G._SQL_MATCHES}, {_SQL_LABELLED},
    g AS (SELECT *, coalesce(topic_group, 'N' || question_id) AS grp, list_concat(allowed, list_filter(comparison, lambda z: NOT list_contains(allowed, z))) AS o, row_number() OVER (PARTITION BY paper, coalesce(topic_group, 'N' || question_id) ORDER BY qnum, question_id) AS nth FROM lb),
    a AS (SELECT paper, grp, o FROM g WHERE nth = 1),
    f AS (SELECT g.paper, g.grp, t.video_id, len(string_split(t.screenshot_ids, '；')) AS n_images, row_number() OVER (PARTITION BY g.paper, g.grp, t.video_id ORDER BY t.isomorph_rank DESC, t.score DESC, t.match_id) AS k, {_SQL_PLACE.replace('o,', 'a.o,')} AS place, t.isomorph_rank AS ir, t.score AS sc, t.screenshot_ids <> '' AS any_image
      FROM table_ t JOIN g USING (question_id) JOIN a ON a.paper IS NOT DISTINCT FROM g.paper AND a.grp = g.grp WHERE t.final_show),
    r AS (SELECT paper, grp, video_id, place, CASE WHEN any_image THEN n_images ELSE 0 END AS n, row_number() OVER (PARTITION BY paper, grp ORDER BY place, ir DESC, sc DESC, video_id) AS shown_at FROM f WHERE k = 1),
    b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY paper, grp ORDER BY shown_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r WHERE shown_at <= {SHOWN_VIDEOS})
    SELECT paper, grp AS label, CAST(shown_at AS INT) AS shown_at, video_id, CAST(place AS INT) AS place, CAST(greatest(least(n, {SHOWN_IMAGES} - before), 0) AS INT) AS n_images FROM b""",
)
def final_layout(spark: SparkSession, d: str) -> DataFrame:
    """What stands beside each question: final videos in display order, a group's questions as one (where its first one stands), each
    video once, ``SHOWN_VIDEOS`` at most, and images over all of them while the budget lasts."""
    q = _labelled(spark, d).withColumn("grp", F.coalesce("topic_group", F.concat(F.lit("N"), "question_id"))).withColumn("o", F.array_union("allowed", "comparison"))
    first = q.groupBy(F.coalesce("paper", F.lit("\0")).alias("pk"), "grp").agg(F.min_by("o", F.struct("qnum", "question_id")).alias("order"))
    m = G._matches(spark, d).where("final_show").select("question_id", "video_id", "match_id", "isomorph_rank", F.col("score").alias("s"), "screenshot_ids")
    both = m.join(q.select("question_id", "paper", F.coalesce("paper", F.lit("\0")).alias("pk"), "grp"), "question_id").join(first, ["pk", "grp"])
    place = K.place_in(F.col("video_id"), F.col("order"))
    images = F.when(F.col("screenshot_ids") != "", F.size(F.split("screenshot_ids", "；"))).otherwise(0)
    once = both.groupBy("pk", "paper", "grp", "video_id").agg(F.min(F.struct((-F.col("isomorph_rank")).alias("i"), (-F.col("s")).alias("s"), "match_id", place.alias("place"), images.alias("n"))).alias("b"))
    shown = K.top_k(once.select("pk", "paper", "grp", "video_id", "b.*"), ["pk", "grp"], [F.asc("place"), F.asc("i"), F.asc("s"), F.asc("video_id")], SHOWN_VIDEOS, "shown_at")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pk", "grp").orderBy("shown_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.least(F.col("n"), SHOWN_IMAGES - before), F.lit(0)).cast("int")
    return shown.withColumn("left", left).select("paper", F.col("grp").alias("label"), "shown_at", "video_id", "place", F.col("left").alias("n_images"))


# --- summary, links, examples ------------------------------------------------------------------------

_SQL_ESCAPE = lambda x: f"replace(replace(replace(replace(coalesce({x}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_SQL_SUMMARY = f"""{M._SQL_KEPT}, cov AS ({_sql_coverage("SELECT question_id FROM kept WHERE final_show")}), links AS (SELECT DISTINCT paper AS title, 'https://docs.example.com/' || length(paper) AS url FROM q WHERE paper LIKE '%（一）'),
ex AS (SELECT q.paper, q.qnum, q.question_type, k.video_id, k.score, row_number() OVER (ORDER BY q.paper, q.qnum, q.question_id, k.score DESC, k.video_id) AS n FROM kept k JOIN q USING (question_id) WHERE final_show AND q.paper IS NOT NULL)"""
#: Examples in a summary.
EXAMPLES = 40


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of papers with the address of each document, by title. The links are a file, as a publishing service leaves it."""
    papers = B.questions(spark, d, "paper").where("paper LIKE '%（一）'").select("paper").distinct()
    entry = F.map_from_entries(F.collect_list(F.struct("paper", F.struct(F.lit("id").alias("doc_id"), F.concat(F.lit("https://docs.example.com/"), F.length("paper")).alias("url")))))
    path = os.path.join(shared_dir(spark), f"links-{uuid.uuid4().hex}")
    papers.agg(F.to_json(entry).alias("value")).coalesce(1).write.text(path)
    return coverage_audit(spark, d).where(F.col("paper").isNotNull()).join(O.read_links(spark, path), F.col("paper") == F.col("title"), "left").select("paper", "n_questions", "n_hits", "points", "points_hit", "url")


@REG.add("manifest_links", f"WITH {_SQL_SUMMARY} SELECT paper, n_questions, n_hits, points, points_hit, url FROM cov LEFT JOIN links ON title = paper WHERE paper IS NOT NULL")
def manifest_links(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d)


@REG.add(
    "summary_lines",
    f"""WITH {_SQL_SUMMARY}, rows_ AS (SELECT 1 AS section, row_number() OVER (ORDER BY paper) AS n, '<tr><td><a href="' || {_SQL_ESCAPE('url')} || '">' || {_SQL_ESCAPE('paper')} || '</a></td><td>' || n_hits || '/' || n_questions || '</td><td>' || points_hit || '/' || CASE WHEN points > 0 THEN CAST(points AS VARCHAR) ELSE '未知' END || '</td></tr>' AS line
      FROM cov JOIN links ON title = paper)
    SELECT section, CAST(n AS INT) AS n, line FROM rows_ UNION ALL SELECT 2, CAST(n AS INT), '<tr><td>' || {_SQL_ESCAPE('paper')} || '</td><td>' || coalesce(CAST(qnum AS VARCHAR), '') || '</td><td>' || {_SQL_ESCAPE('question_type')} || '</td><td>' || {_SQL_ESCAPE('video_id')} || '</td><td>' || score || '</td></tr>' FROM ex WHERE n <= {EXAMPLES}""",
)
def summary_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the summary document: papers with an address and their coverage, and the first examples by paper and number."""
    td = lambda *cells: F.concat(F.lit("<tr><td>"), *[x for c in cells for x in (c, F.lit("</td><td>"))][:-1], F.lit("</td></tr>"))
    linked = _linked(spark, d).where("url IS NOT NULL")
    link = F.concat(F.lit('<a href="'), X.escape(F.col("url")), F.lit('">'), X.escape(F.col("paper")), F.lit("</a>"))
    whole = F.when(F.col("points") > 0, F.col("points").cast("string")).otherwise("未知")
    line = td(link, F.concat_ws("/", "n_hits", "n_questions"), F.concat(F.col("points_hit"), F.lit("/"), whole))
    papers = S.batches(linked.withColumn("line", line).select("paper", "line"), [F.asc("paper")], 1 << 30).select(F.lit(1).alias("section"), F.col("place").alias("n"), "line")
    q = B.questions(spark, d, "paper", "qnum", "question_type").where("paper IS NOT NULL")
    # a question has one final row at most, so the first questions have the first rows
    audit = M._audit(spark, d)
    first = durable(q.join(M._with_final(spark, d), "question_id").orderBy("paper", "qnum", "question_id").limit(EXAMPLES), "examples")
    kept = M._kept(audit.only(first.select("question_id"))).where("final_show").join(first, "question_id")
    few = kept.withColumn("n", F.row_number().over(Window.orderBy("paper", "qnum", "question_id", F.desc("score"), "video_id")))  # EXAMPLES rows at most
    text = td(X.escape(F.col("paper")), X.text(F.col("qnum").cast("string")), X.escape(F.col("question_type")), X.escape(F.col("video_id")), F.col("score").cast("string"))
    return papers.unionByName(few.select(F.lit(2).alias("section"), "n", text.alias("line")))


# --- sections of documents ---------------------------------------------------------------------------

_HEADS = ("试卷分析表", "内容对比表")


def section(body: Column, start: str, end: str) -> tuple[Column, Column]:
    """The text between two headings (null unless both are there, in this order), and why it can't be taken ("" if it can)."""
    a, b = F.lit(f"<h1>{start}</h1>"), F.lit(f"<h1>{end}</h1>")
    at = F.instr(body, a)
    after = F.when(at > 0, F.substring(body, at + F.length(a), F.length(body)))
    stop = F.instr(after, b)
    chunk = F.when(stop > 0, F.trim(F.substring(after, F.lit(1), stop - 1)))
    why = F.when(at == 0, f"no {start}").when(F.coalesce(stop, F.lit(0)) == 0, f"no {end}").when(F.contains(F.lower(chunk), F.lit("<img")), "has an image").otherwise("")
    return F.when(why == "", chunk), why


_SQL_BODY = f"""{B.Q}, bd AS (SELECT paper, '<title>' || paper || '</title><h1>{_HEADS[0]}</h1> <table>' || string_agg(CASE WHEN length(paper) % 3 = 0 AND has_visual THEN '<img/>' ELSE coalesce(question_type, '') END, ',' ORDER BY qnum NULLS FIRST, question_id) || '</table> ' ||
  CASE WHEN length(paper) % 5 = 0 THEN '' ELSE '<h1>{_HEADS[1]}</h1>' END || count(*) AS body FROM q WHERE paper IS NOT NULL GROUP BY paper)"""


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    q = B.questions(spark, d, "paper", "qnum", "question_type", "has_visual").where("paper IS NOT NULL")
    cell = F.when((F.length("paper") % 3 == 0) & F.coalesce("has_visual", F.lit(False)), "<img/>").otherwise(X.text(F.col("question_type")))
    cells = F.array_join(F.array_sort(F.collect_list(F.struct("qnum", "question_id", cell.alias("c"))))["c"], ",")
    g = q.groupBy("paper").agg(cells.alias("c"), F.count(F.lit(1)).alias("n"))
    head = F.when(F.length("paper") % 5 == 0, "").otherwise(f"<h1>{_HEADS[1]}</h1>")
    return g.select("paper", F.concat(F.lit("<title>"), "paper", F.lit(f"</title><h1>{_HEADS[0]}</h1> <table>"), "c", F.lit("</table> "), head, "n").alias("body"))


@REG.add(
    "section_extract",
    f"""WITH {_SQL_BODY}, s AS (SELECT paper, strpos(body, '<h1>{_HEADS[1]}</h1>') AS e, body, strpos(body, '<h1>{_HEADS[0]}</h1>') + {len(_HEADS[0]) + 9} AS a FROM bd),
    c AS (SELECT paper, CASE WHEN e > 0 THEN trim(body[a:e - 1]) END AS chunk, body FROM s)
    SELECT paper, CASE WHEN NOT contains(lower(chunk), '<img') THEN chunk END AS chunk, CASE WHEN chunk IS NULL THEN 'no {_HEADS[1]}' WHEN contains(lower(chunk), '<img') THEN 'has an image' ELSE '' END AS refused,
      chunk IS NOT NULL AND contains(body, chunk) AND (length(body) - length(replace(body, '<img', ''))) // 4 = 0 AS unchanged FROM c""",
)
def section_extract(spark: SparkSession, d: str) -> DataFrame:
    """The section between two headings of each document, or why it is refused; and whether putting it back leaves the rest and the
    number of images as they were."""
    b = _bodies(spark, d)
    chunk, why = section(F.col("body"), *_HEADS)
    whole = b.select("paper", "body", chunk.alias("chunk"), why.alias("refused"))
    again = F.replace("body", F.col("chunk"), F.col("chunk"))
    same = F.when(F.col("refused").startswith("no "), False).otherwise((F.coalesce(again, F.col("body")) == F.col("body")) & (X.count_of(F.col("body"), "<img") == 0))
    return whole.select("paper", "chunk", "refused", same.alias("unchanged"))


# --- sheets: written as an export, read back ---------------------------------------------------------


def _export(spark: SparkSession, d: str) -> str:
    """The videos as a sheet export: a header row, and a row per video by column letters."""
    path = os.path.join(shared_dir(spark), f"sheet-{uuid.uuid4().hex}")
    v = B.videos(spark, d, "source", "hierarchy", "video_name", "screenshot_refs").select("video_id", "source", "hierarchy", "video_name", "screenshot_refs")
    refs = F.split(X.text(F.col("screenshot_refs")), "；")
    cells = {
        "A": F.col("video_id"), "B": F.concat(F.lit(" "), X.text(F.col("source")), F.lit("  ")), "C": F.col("hierarchy"), "K": F.when(X.text(F.col("screenshot_refs")) != "", F.element_at(refs, 1)),
        "AA": F.when(F.size(refs) > 1, F.element_at(refs, 2)), "AB": F.lit("z"),
    }
    body = v.select(F.struct((F.pmod(F.xxhash64("video_id"), F.lit(1_000_000)) + 2).cast("int").alias("row_number"), F.create_map(*[x for c, value in cells.items() for x in (F.lit(c), value)]).alias("values")).alias("r"))
    head = spark.range(1).select(F.struct(F.lit(1).alias("row_number"), F.create_map(*[F.lit(x) for p in (("A", "id"), ("B", "source"), ("K", "图"), ("AA", "图"), ("AB", "other")) for x in p]).alias("values")).alias("r"))
    # many files of rows, as exports are read in ranges
    files = body.unionByName(head).groupBy(F.pmod(F.xxhash64("r.row_number"), F.lit(16))).agg(F.collect_list("r").alias("rows"))
    files.select(F.lit(True).alias("ok"), F.struct("rows").alias("data")).write.json(path)
    return path


@REG.add(
    "sheet_rows",
    f"""WITH {B.V}, s AS (SELECT video_id, trim(coalesce(source, '')) AS source, string_split(coalesce(screenshot_refs, ''), '；') AS a, coalesce(screenshot_refs, '') <> '' AS has FROM v)
    SELECT video_id, source, array_to_string(list_filter([CASE WHEN has THEN 'K:' || coalesce(nullif(trim(a[1]), ''), '图') END, CASE WHEN len(a) > 1 THEN 'AA:' || coalesce(nullif(trim(a[2]), ''), '图') END], lambda z: z IS NOT NULL), '；') AS refs, 'K' AS first_column, 'AA' AS last_column FROM s WHERE has""",
)
def sheet_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a sheet export: cells trimmed, the columns titled as images found by the header, header rows dropped, and only rows
    with a reference kept; with the least and greatest of the columns."""
    rows = sheets.read_rows(spark, _export(spark, d), "sheet", lines=True)
    columns = sheets.columns_titled(rows, "图")
    low, high = sheets.columns_between(columns)
    got = sheets.with_references(sheets.body_rows(rows), columns)
    return got.select(sheets.cell("A").alias("video_id"), sheets.cell("B").alias("source"), F.array_join("refs", "；").alias("refs"), F.lit(low).alias("first_column"), F.lit(high).alias("last_column"))


@REG.add("course_filter", f"WITH {B.V} SELECT video_id, source FROM v WHERE coalesce(source, '') <> '专题库' OR question_type = '基础题'")
def course_filter(spark: SparkSession, d: str) -> DataFrame:
    """One source keeps only rows of a type, all others keep theirs."""
    return B.videos(spark, d, "source", "question_type").where((X.text(F.col("source")) != "专题库") | (F.col("question_type") == "基础题")).select("video_id", "source")


@REG.add(
    "csv_lines",
    f"""WITH {B.V}, r AS (SELECT sheet_id, source_row, min(video_id) AS video_id FROM v WHERE sheet_id IS NOT NULL AND source_row IS NOT NULL GROUP BY 1, 2), m AS (SELECT sheet_id, max(source_row) AS top FROM r GROUP BY 1), e AS (SELECT sheet_id, unnest(range(2, top + 1)) AS n FROM m),
    w AS (SELECT v.video_id, coalesce(question_type, '') AS t, coalesce(knowledge_tags, '') AS k, coalesce(CAST(difficulty AS VARCHAR), '') AS f FROM v)
    SELECT e.sheet_id, CAST(n AS INT) AS source_row, CASE WHEN r.video_id IS NULL THEN ',,,' ELSE r.video_id || ',' || {{c1}} || ',' || {{c2}} || ',' || f END AS line FROM e LEFT JOIN r ON r.sheet_id = e.sheet_id AND r.source_row = n LEFT JOIN w ON w.video_id = r.video_id""".replace(
        "{c1}", "CASE WHEN regexp_matches(t, '[\",\\n\\r]') THEN '\"' || replace(t, '\"', '\"\"') || '\"' ELSE t END"
    ).replace("{c2}", "CASE WHEN regexp_matches(k, '[\",\\n\\r]') THEN '\"' || replace(k, '\"', '\"\"') || '\"' ELSE k END"),
)
def csv_lines(spark: SparkSession, d: str) -> DataFrame:
    """What is written back to each sheet: a line for every row below the header, empty cells where there is no video, quoted where needed."""
    v = B.videos(spark, d, "sheet_id", "source_row", "question_type", "knowledge_tags", "difficulty").where("sheet_id IS NOT NULL AND source_row IS NOT NULL")
    one = v.groupBy("sheet_id", "source_row").agg(F.min_by(F.struct("video_id", "question_type", "knowledge_tags", "difficulty"), "video_id").alias("r"))
    rows = S.dense_rows(one, "sheet_id", "source_row", low=2)
    line = F.concat_ws(",", *[X.csv_cell(F.col(f"r.{c}").cast("string")) for c in ("video_id", "question_type", "knowledge_tags", "difficulty")])
    return rows.select("sheet_id", "source_row", line.alias("line"))


@REG.add(
    "override_files",
    f"""WITH {B.Q}, o AS (SELECT paper, qnum, min(question_id) AS k FROM q WHERE paper IS NOT NULL AND qnum IS NOT NULL GROUP BY 1, 2)
    SELECT paper, CAST(qnum AS INT) AS qnum, 'allow' AS promotion, 'second' AS audit_note, k AS allowed FROM o WHERE qnum % 3 = 0""",
)
def override_files(spark: SparkSession, d: str) -> DataFrame:
    """Overrides written as two files a paper and read back: the last by path counts, whole."""
    q = B.questions(spark, d, "paper", "qnum").where("paper IS NOT NULL AND qnum IS NOT NULL").groupBy("paper", "qnum").agg(F.min("question_id").alias("k"))
    path = os.path.join(shared_dir(spark), f"overrides-{uuid.uuid4().hex}")
    for part, (promotion, note) in enumerate((("exclude", "first"), ("allow", "second"))):
        rows = q if part == 0 else q.where("qnum % 3 = 0")
        entry = F.struct(F.col("qnum").cast("string").alias("key"), F.struct(F.lit(promotion).alias("promotion"), F.lit(note).alias("audit_note"), F.array("k").alias("allowed_video_ids")).alias("value"))
        files = rows.groupBy("paper").agg(F.map_from_entries(F.collect_list(entry)).alias("questions"))
        files.write.json(os.path.join(path, f"{part}_v5"))
    got = O.read_overrides(spark, os.path.join(path, "*"), lines=True)
    return got.select("paper", "qnum", "promotion", "audit_note", F.get("allowed_video_ids", F.lit(0)).alias("allowed"))


# --- word-processor files: packed and read on the executors -------------------------------------------

_SPACES = (
    'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
)


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A document for each row: a paragraph for each line, an image after every third, and a table of the cells; those of
    papers with a name of 17 characters are cut off in the middle."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    for b in batches:
        out = []
        for paper, lines, cells in zip(b["paper"], b["lines"], b["cells"], strict=True):
            par = lambda t: f"<w:p><w:r><w:t>{escape(t)}</w:t></w:r></w:p>"
            body = "".join(par(t) + ('<w:p><w:r><a:blip r:embed="rId1"/><a:blip r:embed="none"/></w:r></w:p>' if i % 3 == 2 else "") for i, t in enumerate(lines))
            table = "".join("<w:tr>" + "".join(f"<w:tc>{par(c)}</w:tc>" for c in row.split("|")) + "</w:tr>" for row in cells)
            f = io.BytesIO()
            with zipfile.ZipFile(f, "w") as z:
                z.writestr("word/document.xml", f"<w:document {_SPACES}><w:body>{body}<w:tbl>{table}</w:tbl><w:sectPr/></w:body></w:document>")
                z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="media/i.png"/></Relationships>')
            out.append((paper, f.getvalue() if len(paper) != 17 else f.getvalue()[: len(f.getvalue()) // 2]))
        yield pd.DataFrame(out, columns=["path", "content"])


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    q = B.questions(spark, d, "paper", "qnum", "question_type", "score").where("paper IS NOT NULL")
    line, cell = F.concat_ws(" ", "question_id", "question_type"), F.concat(X.text(F.col("qnum").cast("string")), F.lit("|"), X.text(F.col("score").cast("string")))
    rows = F.array_sort(F.collect_list(F.struct("qnum", "question_id", line.alias("line"), cell.alias("cell"))))
    g = q.groupBy("paper").agg(rows.alias("r")).select("paper", F.col("r.line").alias("lines"), F.col("r.cell").alias("cells"))
    return D.blocks(g.mapInPandas(_packed, "path string, content binary"))


_SQL_DOCS = f"""{B.Q}, l AS (SELECT paper, question_id, qnum, concat_ws(' ', question_id, question_type) AS line, coalesce(CAST(qnum AS VARCHAR), '') || ' | ' || coalesce(CAST(score AS VARCHAR), '') AS cell, row_number() OVER (PARTITION BY paper ORDER BY qnum NULLS FIRST, question_id) AS n FROM q WHERE paper IS NOT NULL AND length(paper) <> 17),
  bl AS (SELECT paper AS path, n - 1 + (n - 1) // 3 AS ord, 'p' AS kind, line AS text, '' AS images FROM l UNION ALL SELECT paper, n + n // 3 - 1, 'p', '', 'media/i.png' FROM l WHERE n % 3 = 0
    UNION ALL SELECT paper, max(n) + max(n) // 3, 'table', string_agg(cell, chr(10) ORDER BY n), '' FROM l GROUP BY 1)"""


@REG.add("doc_blocks", f"WITH {_SQL_DOCS} SELECT path, CAST(ord AS INT) AS ord, kind, text, images FROM bl")
def doc_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of documents, in order, with the images they refer to; unknown references are dropped, broken files left out."""
    return _blocks(spark, d).where("error IS NULL").select("path", "ord", "kind", "text", F.array_join("images", ",").alias("images"))


@REG.add("doc_media", f"WITH {_SQL_DOCS} SELECT path, images AS image, CAST(min(ord) AS INT) AS ord FROM bl WHERE images <> '' GROUP BY 1, 2")
def doc_media(spark: SparkSession, d: str) -> DataFrame:
    return D.media_of(_blocks(spark, d).where("error IS NULL"))


@REG.add(
    "doc_texts",
    f"""WITH {_SQL_DOCS} SELECT path, 'parsed' AS status, string_agg(text, chr(10) ORDER BY kind = 'table', ord) FILTER (text <> '') AS text FROM bl GROUP BY 1
    UNION ALL SELECT DISTINCT paper, 'failed', '' FROM q WHERE paper IS NOT NULL AND length(paper) = 17""",
)
def doc_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text of each document, paragraphs before tables; one that can't be read has an empty text and says so."""
    parts = F.array_sort(F.collect_list(F.struct((F.col("kind") == "table").alias("last"), "ord", "text")))
    body = F.array_join(F.filter(parts["text"], lambda x: x != ""), "\n")
    g = _blocks(spark, d).groupBy("path").agg(body.alias("text"), F.max("error").alias("error"))
    return g.select("path", F.when(F.col("error").isNull(), "parsed").otherwise("failed").alias("status"), "text")


@REG.add(
    "shown_first",
    f"WITH {B.M}, r AS (SELECT question_id, match_id, row_number() OVER (PARTITION BY question_id ORDER BY final_show DESC, score DESC, match_id) AS n FROM m WHERE question_id <> '' AND score IS NOT NULL AND NOT isnan(score)) SELECT question_id, CAST(n AS INT) AS n, match_id FROM r WHERE n <= 4",
)
def shown_first(spark: SparkSession, d: str) -> DataFrame:
    """The four matches of a question that a page shows first: final ones, then by score."""
    m = B.matches(spark, d, "question_id", "score", "final_show").where("question_id <> '' AND score IS NOT NULL AND NOT isnan(score)")
    return K.top_k(m, ["question_id"], [F.desc_nulls_last("final_show"), F.desc("score"), F.asc("match_id")], 4, "n").select("question_id", "n", "match_id")


#: What an intake must have, and what it may have, with the endings of the files.
REQUIRED = {"paper_word": [".docx"], "paper_pdf": [".pdf"]}
OPTIONAL = {"official_analysis": [".pdf", ".docx", ".txt", ".md"]}


def intake_problem(files: dict[str, Column]) -> Column:
    """The first problem of an intake ("" if there is none): files that are missing or have another ending. Names are columns."""
    cases = []
    for need, kinds in ((True, REQUIRED), (False, OPTIONAL)):
        for field, ends in kinds.items():
            name = F.lower(X.text(files[field]))
            if need:
                cases.append((name == "", f"{field} is required"))
            other = ~name.rlike("(" + "|".join(e.replace(".", "\\.") for e in ends) + ")$")
            cases.append(((name != "") & other, f"{field} must be one of {', '.join(ends)}"))
    out = F.lit("")
    for test, problem in reversed(cases):
        out = F.when(test, problem).otherwise(out)
    return out


@REG.add(
    "intake_checks",
    f"""WITH {B.T}, f AS (SELECT transcript_id, lower(coalesce(file_name, '')) AS w, CASE WHEN parse_status = 'failed' THEN '' ELSE lower(coalesce(file_name, '') || '.pdf') END AS p, CASE WHEN length(file_name) % 3 = 0 THEN lower(file_name || '.xlsx') ELSE '' END AS a FROM t)
    SELECT transcript_id, CASE WHEN w = '' THEN 'paper_word is required' WHEN NOT suffix(w, '.docx') THEN 'paper_word must be one of .docx' WHEN p = '' THEN 'paper_pdf is required' WHEN NOT suffix(p, '.pdf') THEN 'paper_pdf must be one of .pdf'
      WHEN a <> '' AND NOT regexp_matches(a, '(\\.pdf|\\.docx|\\.txt|\\.md)$') THEN 'official_analysis must be one of .pdf, .docx, .txt, .md' ELSE '' END AS problem FROM f""",
)
def intake_checks(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with an intake, over made-up intakes of one to three files."""
    t = B.transcripts(spark, d, "file_name", "parse_status")
    name = X.text(F.col("file_name"))
    files = {"paper_word": name, "paper_pdf": F.when(F.col("parse_status") == "failed", "").otherwise(F.concat(name, F.lit(".pdf"))), "official_analysis": F.when(F.length("file_name") % 3 == 0, F.concat(name, F.lit(".xlsx"))).otherwise("")}
    return t.select("transcript_id", intake_problem(files).alias("problem"))
