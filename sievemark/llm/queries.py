"""The queries of this package, and the SQL that checks them."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.functions.cells import cell_values
from sievemark.llm.leakage import find_leaks
from sievemark.llm.lookalike import canonical_texts, look_classes, same_look_pairs
from sievemark.llm.mixture import mix, mixture_report
from sievemark.llm.similar_sets import set_members, similar_links, similar_pairs
from sievemark.llm.subjects import leaf_mixtures, subject_shares, subjects_of
from sievemark.llm.topn import top_n
from sievemark.operators.packed import record_cells
from sievemark.operators.records import first_delivery
from sievemark.queries import Registry
from sievemark.session import durable, table

REG = Registry()


def _tag_sets(spark: SparkSession, d: str) -> DataFrame:
    fields = ["knowledge_tags", "problem_tags"]
    cells = record_cells(table(spark, d, "exam_record"), "exam_record", "question_id", fields).unionByName(
        record_cells(table(spark, d, "video_record"), "video_record", "video_id", fields)
    )
    return set_members(cells.withColumn("vals", cell_values(F.col("cell"))), "field_name", "record_id", "vals")


_SQL_TAGS = r"""
cells AS (
  SELECT 'knowledge_tags' AS field_name, question_id AS id, arg_min(coalesce(knowledge_tags, ''), imported_at) AS cell FROM exam_record GROUP BY question_id
  UNION ALL SELECT 'problem_tags', question_id, arg_min(coalesce(problem_tags, ''), imported_at) FROM exam_record GROUP BY question_id
  UNION ALL SELECT 'knowledge_tags', video_id, arg_min(coalesce(knowledge_tags, ''), imported_at) FROM video_record GROUP BY video_id
  UNION ALL SELECT 'problem_tags', video_id, arg_min(coalesce(problem_tags, ''), imported_at) FROM video_record GROUP BY video_id
),
parts AS (
  SELECT field_name, id, unnest(regexp_extract_all(regexp_replace(regexp_replace(cell, '^[\s\x{3000}]*\[', ''), '\][\s\x{3000}]*$', ''),
      '"(?:[^"\\]|""|\\.)*"|''[^'']*''|“[^”]*”|「[^」]*」|[^,，、;；/／|｜\s\x{3000}"''“「]+')) AS v
  FROM cells
),
tags AS (
  SELECT DISTINCT field_name, id, CASE WHEN v[1] = '"' THEN replace(replace(v[2:-2], '""', '"'), '\"', '"') WHEN v[1] IN ('''', '“', '「') THEN v[2:-2] ELSE v END AS tag FROM parts
),
sizes AS (SELECT field_name, id, count(*) AS n FROM tags GROUP BY 1, 2),
shared AS (
  SELECT a.field_name, a.id AS id_a, b.id AS id_b, count(*) AS c FROM tags a JOIN tags b ON a.field_name = b.field_name AND a.tag = b.tag AND a.id < b.id GROUP BY 1, 2, 3
),
pairs AS (
  SELECT s.field_name, s.id_a, s.id_b FROM shared s
  JOIN sizes x ON x.field_name = s.field_name AND x.id = s.id_a JOIN sizes y ON y.field_name = s.field_name AND y.id = s.id_b
  WHERE 5 * s.c >= 3 * (x.n + y.n - s.c)
)
"""


@REG.add("p1_found", f"WITH {_SQL_TAGS} SELECT field_name, id_a, id_b FROM pairs")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(_tag_sets(spark, d)).select(F.col("grp").alias("field_name"), "id_a", "id_b")


@REG.add(
    "p1_links",
    f"""WITH {_SQL_TAGS},
    sets AS (SELECT field_name, id, string_agg(tag, chr(10) ORDER BY tag) AS s FROM tags GROUP BY 1, 2),
    classes AS (SELECT field_name, s, min(id) AS class_id, count(*) AS size FROM sets GROUP BY 1, 2),
    ways AS (SELECT field_name, id_a AS id, id_b AS other FROM pairs UNION ALL SELECT field_name, id_b, id_a FROM pairs),
    links AS (SELECT field_name, id, count(*) AS n FROM ways GROUP BY 1, 2)
    SELECT x.field_name, x.id AS record_id, c.class_id, c.size - 1 AS n_copies, CAST(coalesce(l.n, 0) - (c.size - 1) AS BIGINT) AS n_links
    FROM sets x JOIN classes c ON c.field_name = x.field_name AND c.s = x.s LEFT JOIN links l ON l.field_name = x.field_name AND l.id = x.id""",
)
def p1_links(spark: SparkSession, d: str) -> DataFrame:
    return similar_links(_tag_sets(spark, d)).select(F.col("grp").alias("field_name"), F.col("record").alias("record_id"), "class_id", "n_copies", "n_links")


def _looks(spark: SparkSession, d: str) -> DataFrame:
    exam = first_delivery(table(spark, d, "exam_record"), "question_id", "imported_at", "stem")
    video = first_delivery(table(spark, d, "video_record"), "video_id", "imported_at", "video_name", "content_summary")
    q = exam.select(F.col("question_id").alias("record_id"), "stem")
    v = video.select(F.col("video_id").alias("record_id"), "video_name", "content_summary")
    return canonical_texts(q, ["record_id"], ["stem"]).unionByName(canonical_texts(v, ["record_id"], ["video_name", "content_summary"]))


#: Look-alike letters and marks for the SQL, written down apart from those of the operator.
_SQL_LETTERS = [
    ("АВЕЅІЈКМНОРСТУХ", "ABESIJKMHOPCTYX"), ("асеһіјорѕху", "acehijopsxy"), ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"), ("αορν", "aopv"),
    ("‐‑−∶∼〜•・‧", "---:~~···"),
]


def _sql_canonical(x: str) -> str:
    """The canonical form as SQL: compatibility composition of single characters that look the same, and a list of letters.

    It has no part in the trie; it is right for texts in which no word has another spelling than the table's.
    """
    blocks = [range(0xA0, 0xB8), range(0x2000, 0x2070), range(0x2F00, 0x2FD6), range(0x3000, 0x3001), range(0xF900, 0xFB00), range(0xFF01, 0xFFE7)]
    raised = {c for b in blocks for c in b if unicodedata.decomposition(chr(c)).startswith(("<super>", "<sub>", "<circle>", "<fraction>"))}
    forms = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for b in blocks for c in b if c not in raised]
    pairs = [(a, b) for a, b in forms if a != b and len(b) == 1] + [(a, b) for x in _SQL_LETTERS for a, b in zip(*x, strict=True)]
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    seen = rf"regexp_replace(replace({x}, '℃', '°C'), '[\x{{ad}}\x{{200b}}-\x{{200f}}\x{{2060}}-\x{{2064}}\x{{fe00}}-\x{{fe0f}}\x{{feff}}]', '', 'g')"
    return f"nfc_normalize(translate({seen}, {quote(''.join(a for a, _ in pairs))}, {quote(''.join(b for _, b in pairs))}))"


_SQL_LOOKS = f"""
texts AS (
  SELECT 'stem' AS field_name, question_id AS id, arg_min(stem, imported_at) AS raw FROM exam_record GROUP BY question_id
  UNION ALL SELECT 'video_name', video_id, arg_min(video_name, imported_at) FROM video_record GROUP BY video_id
  UNION ALL SELECT 'content_summary', video_id, arg_min(content_summary, imported_at) FROM video_record GROUP BY video_id
),
looks AS (SELECT field_name, id, raw, {_sql_canonical('raw')} AS canonical FROM texts WHERE raw IS NOT NULL)
"""


@REG.add("p2_found", f"WITH {_SQL_LOOKS} SELECT a.field_name, a.id AS id_a, b.id AS id_b FROM looks a JOIN looks b ON a.field_name = b.field_name AND a.canonical = b.canonical AND a.raw <> b.raw AND a.id < b.id")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return same_look_pairs(_looks(spark, d), "record_id")


@REG.add("p2_canonical", f"WITH {_SQL_LOOKS} SELECT field_name, id AS record_id, canonical, raw <> canonical AS changed FROM looks")
def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every text of the three fields in its canonical form."""
    return _looks(spark, d).select("field_name", "record_id", "canonical", (F.col("raw") != F.col("canonical")).alias("changed"))


@REG.add(
    "p2_looks",
    f"""WITH {_SQL_LOOKS}, c AS (SELECT field_name, canonical, min(id) AS class_id, count(*) AS n_records, count(DISTINCT raw) AS n_spellings FROM looks GROUP BY 1, 2)
    SELECT l.field_name, l.id AS record_id, class_id, n_records, n_spellings FROM looks l JOIN c ON c.field_name = l.field_name AND c.canonical = l.canonical""",
)
def p2_looks(spark: SparkSession, d: str) -> DataFrame:
    """Every text of the three fields with its class of texts that look the same: representative and membership, no pairs."""
    c = look_classes(_looks(spark, d), "record_id")
    return c.select("field_name", F.col("id").alias("record_id"), "class_id", "n_records", "n_spellings")


_SQL_TOP = """
best AS (
  SELECT question_id, video_id, max(score) AS score FROM match_audit
  WHERE question_id <> '' AND video_id <> '' AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, video_id) AS rnk FROM best)
"""


@REG.add("p3_found", f"WITH {_SQL_TOP} SELECT question_id, rnk, video_id FROM ranked WHERE rnk <= 3")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n(table(spark, d, "match_audit"), "question_id", "video_id", "score", 3).select("question_id", "rnk", "video_id")


@REG.add("p3_top10", f"WITH {_SQL_TOP} SELECT question_id, rnk, video_id, score FROM ranked WHERE rnk <= 10")
def p3_top10(spark: SparkSession, d: str) -> DataFrame:
    return top_n(table(spark, d, "match_audit"), "question_id", "video_id", "score", 10)


_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def _sql_windows(name: str, table_name: str, key: str, text: str) -> str:
    folded = rf"regexp_replace(lower(translate({text}, '{_WIDE}', '{_NARROW.replace(chr(39), chr(39) * 2)}')), '[^\p{{L}}\p{{Nd}}]', '', 'g')"
    return f"{name}_t AS (SELECT {key}, {folded} AS t FROM {table_name} WHERE {text} IS NOT NULL), {name} AS (SELECT DISTINCT {key}, t[i:i + 29] AS w FROM (SELECT {key}, t, unnest(range(1, length(t) - 28)) AS i FROM {name}_t))"


@REG.add("p6_found", f"WITH {_sql_windows('dw', 'documents', 'doc_id', 'text')}, {_sql_windows('iw', 'eval_items', 'item_id', 'item_text')} SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (w)")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


@REG.add("p6_coverage")
def p6_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold half of an item or more, in passages of 16 characters and up, in any order."""
    leaks = find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), min_run=16, least_coverage=0.5)
    return leaks.select("doc_id", "item_id", "n_tiles", "n_covered", F.round("coverage", 6).alias("coverage"))


@REG.add("p7_mixture")
def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "source_targets"))


@REG.add("p7_shares")
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "source_targets")
    return mixture_report(mix(table(spark, d, "documents"), targets), targets)


@REG.add(
    "p7_checks",
    """SELECT t.source, d.source IS NOT NULL AS has_documents, true AS share_met, true AS repeats_kept, true AS documents_are_its_own
    FROM (SELECT source, max(target_share) AS s, max(max_repeats) AS r FROM source_targets WHERE source IS NOT NULL GROUP BY 1) t
    LEFT JOIN (SELECT DISTINCT source FROM documents WHERE text <> '') d ON d.source = t.source AND s > 0 AND r > 0""",
)
def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """What has to hold of the mixture, by source: its share to within a document a source, its cap on uses, and that what is used
    for it are documents of that source."""
    docs, targets = table(spark, d, "documents"), table(spark, d, "source_targets")
    m = durable(mix(docs, targets), "mixture")
    report = mixture_report(m, targets).withColumn("has_documents", F.col("n_documents") > 0)
    of = lambda df, column: df.agg(column).scalar()
    all_, most = of(m, F.sum(F.col("n_uses") * F.col("n_tokens"))), of(m, F.max("n_tokens"))
    there = report.where("has_documents")
    wanted, n = of(there, F.sum("target_share")), of(there, F.count(F.lit(1)))
    foreign = m.join(docs.select("doc_id", "source"), ["doc_id", "source"], "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("foreign"))
    every = report.join(foreign, "source", "left")
    near = F.abs(F.col("actual_share") - F.col("target_share") / wanted) * all_ <= most * (n + 1)
    met = F.when(F.col("has_documents"), near).otherwise(F.col("n_tokens") == 0)
    return every.select("source", "has_documents", met.alias("share_met"), (F.col("most_uses") <= F.col("max_repeats")).alias("repeats_kept"), F.col("foreign").isNull().alias("documents_are_its_own"))


@REG.add("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects_of(subject_shares(table(spark, d, "documents"), table(spark, d, "doc_labels"), table(spark, d, "subjects")))


@REG.add(
    "p8_checks",
    "SELECT count(*) AS n_documents, true AS shares_add_up, true AS sentences_are_whole, true AS subjects_are_known FROM documents WHERE regexp_matches(text, '\\p{L}')",
)
def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """What has to hold of the mixtures of leaves: shares within a document add up to 1 at most, are whole sentences, of known subjects."""
    docs, subjects = table(spark, d, "documents"), table(spark, d, "subjects")
    leaf = durable(leaf_mixtures(docs, table(spark, d, "doc_labels"), subjects), "leaves")
    per = leaf.groupBy("doc_id").agg(F.sum("share").alias("s"), F.max(F.abs(F.col("share") * F.col("n_sentences") - F.round(F.col("share") * F.col("n_sentences")))).alias("off"))
    with_letters = docs.where(F.col("text").rlike(r"\p{L}")).select("doc_id")
    strange = leaf.where(F.col("subject_code").isNotNull()).join(subjects, "subject_code", "left_anti").agg(F.count(F.lit(1))).scalar()
    every = with_letters.join(per, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("n_documents"), (F.coalesce(F.max("s"), F.lit(0.0)) <= 1 + 1e-9).alias("shares_add_up"), (F.coalesce(F.max("off"), F.lit(0.0)) < 1e-6).alias("sentences_are_whole")
    )
    return every.withColumn("subjects_are_known", strange == 0)


@REG.add("p8_composition")
def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """The make-up of the corpus: per subject the documents that deal with it and its sentences in all documents."""
    shares = subject_shares(table(spark, d, "documents"), table(spark, d, "doc_labels"), table(spark, d, "subjects"))
    return shares.groupBy("subject_code").agg(
        F.count_if(F.col("share") >= 0.25).alias("n_documents"), F.sum(F.round(F.col("share") * F.col("n_sentences")).cast("bigint")).alias("n_sentences")
    )
