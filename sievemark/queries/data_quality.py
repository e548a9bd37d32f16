"""Packed cells (p4) and orphaned references (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.operators.packed import record_cells, unpack
from sievemark.operators.references import ForeignKey, Records, direct_orphans, orphan_cascade, orphan_report
from sievemark.queries import Registry
from sievemark.session import table

REG = Registry()


def _cells(spark: SparkSession, d: str) -> DataFrame:
    exam = record_cells(table(spark, d, "exam_record"), "exam_record", "question_id", ["knowledge_tags", "problem_tags"])
    video = record_cells(table(spark, d, "video_record"), "video_record", "video_id", ["problem_tags", "screenshot_tokens"])
    return exam.unionByName(video)


# The SQL tokenizer: quoted parts and bare runs in turn, by one regular expression; marks and escapes are then taken off.
_SQL_CELLS = r"""
cells AS (
  SELECT 'exam_record' AS table_name, question_id AS record_id, 'knowledge_tags' AS field_name, arg_min(coalesce(knowledge_tags, ''), imported_at) AS cell FROM exam_record GROUP BY question_id
  UNION ALL SELECT 'exam_record', question_id, 'problem_tags', arg_min(coalesce(problem_tags, ''), imported_at) FROM exam_record GROUP BY question_id
  UNION ALL SELECT 'video_record', video_id, 'problem_tags', arg_min(coalesce(problem_tags, ''), imported_at) FROM video_record GROUP BY video_id
  UNION ALL SELECT 'video_record', video_id, 'screenshot_tokens', arg_min(coalesce(screenshot_tokens, ''), imported_at) FROM video_record GROUP BY video_id
),
parts AS (
  SELECT table_name, record_id, field_name,
    regexp_extract_all(regexp_replace(regexp_replace(cell, '^[\s\x{3000}]*\[', ''), '\][\s\x{3000}]*$', ''),
      '"(?:[^"\\]|""|\\.)*"|''[^'']*''|“[^”]*”|「[^」]*」|[^,，、;；/／|｜\s\x{3000}"''“「]+') AS vals
  FROM cells
),
marked AS (
  SELECT table_name, record_id, field_name, unnest(vals) AS v, unnest(range(1, len(vals) + 1)) AS pos FROM parts
),
found AS (
  SELECT table_name, record_id, field_name, CAST(pos AS BIGINT) AS pos,
    CASE WHEN v[1] = '"' THEN replace(replace(v[2:-2], '""', '"'), '\"', '"') WHEN v[1] IN ('''', '“', '「') THEN v[2:-2] ELSE v END AS item_value
  FROM marked
)
"""


@REG.add("p4_found", f"WITH {_SQL_CELLS} SELECT table_name, record_id, field_name, pos, item_value FROM found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return unpack(_cells(spark, d)).select("table_name", "record_id", "field_name", "pos", "item_value")


@REG.add(
    "p4_value_counts",
    f"""WITH {_SQL_CELLS} SELECT table_name, field_name, item_value, count(*) AS n_values, count(DISTINCT record_id) AS n_records
    FROM found GROUP BY 1, 2, 3""",
)
def p4_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return unpack(_cells(spark, d)).groupBy("table_name", "field_name", "item_value").agg(
        F.count(F.lit(1)).alias("n_values"), F.countDistinct("record_id").alias("n_records")
    )


def _graph(spark: SparkSession, d: str) -> tuple[dict[str, Records], list[ForeignKey]]:
    of = lambda name, key, arrived="imported_at", deleted="deleted_at": Records(name, table(spark, d, name), key, arrived, deleted)
    tables = {t.name: t for t in (of("exam_record", "question_id"), of("video_record", "video_id"), of("transcript_record", "transcript_id"), of("match_audit", "match_id", "ingested_at", None))}
    edges = [
        ForeignKey("match_audit", "question_id", "exam_record", "audited_at"),
        ForeignKey("match_audit", "video_id", "video_record", "audited_at"),
        ForeignKey("video_record", "transcript_id", "transcript_record", "imported_at", first=True),
    ]
    return tables, edges


_SQL_ORPHANS = """
refs AS (
  SELECT DISTINCT 'match_audit' AS table_name, 'question_id' AS field_name, match_id AS record_id, question_id AS ref_key, 'exam_record' AS parent, audited_at AS at FROM match_audit WHERE question_id <> ''
  UNION ALL SELECT DISTINCT 'match_audit', 'video_id', match_id, video_id, 'video_record', audited_at FROM match_audit WHERE video_id <> ''
  UNION ALL SELECT 'video_record', 'transcript_id', video_id, arg_min(transcript_id, imported_at), 'transcript_record', min(imported_at) FROM video_record GROUP BY video_id
),
life AS (
  SELECT 'exam_record' AS parent, question_id AS ref_key, min(imported_at) AS first_at, min(deleted_at) AS deleted_at FROM exam_record GROUP BY 2
  UNION ALL SELECT 'video_record', video_id, min(imported_at), min(deleted_at) FROM video_record GROUP BY 2
  UNION ALL SELECT 'transcript_record', transcript_id, min(imported_at), min(deleted_at) FROM transcript_record GROUP BY 2
),
direct AS (
  SELECT table_name, field_name, record_id, r.ref_key,
    CASE WHEN l.ref_key IS NULL THEN 'missing' WHEN l.deleted_at <= r.at THEN 'deleted' WHEN l.first_at > r.at THEN 'late' END AS orphan_kind,
    strftime(r.at, '%Y-%m') AS period_month
  FROM refs r LEFT JOIN life l ON l.parent = r.parent AND l.ref_key = r.ref_key WHERE r.ref_key <> ''
),
cases AS (SELECT * FROM direct WHERE orphan_kind IS NOT NULL)
"""


@REG.add("p5_found", f"WITH {_SQL_ORPHANS} SELECT table_name, field_name, record_id, ref_key, orphan_kind, period_month FROM cases")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return direct_orphans(*_graph(spark, d))


@REG.add(
    "p5_report",
    f"""WITH {_SQL_ORPHANS},
    cascade AS (
      SELECT *, 'direct' AS orphan_class FROM cases
      UNION ALL
      SELECT DISTINCT r.table_name, r.field_name, r.record_id, r.ref_key, 'inherited', strftime(r.at, '%Y-%m'), 'inherited'
      FROM refs r JOIN cases v ON v.table_name = 'video_record' AND v.record_id = r.ref_key AND r.field_name = 'video_id'
      WHERE NOT EXISTS (SELECT 1 FROM cases c WHERE c.table_name = r.table_name AND c.field_name = r.field_name AND c.record_id = r.record_id)
    )
    SELECT table_name, field_name, period_month, orphan_kind, orphan_class, count(*) AS n_references, count(DISTINCT record_id) AS n_records
    FROM cascade GROUP BY 1, 2, 3, 4, 5""",
)
def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(orphan_cascade(*_graph(spark, d)))
