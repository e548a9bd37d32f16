"""Reviewers' overrides, document links and intake manifests: JSON with keyed maps, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TEXTS = ("primary_type", "knowledge_tags", "problem_tags", "visual_forms", "background_tags", "task_tags", "task_models", "method_models", "core_experiment_models", "project_chain", "promotion", "audit_note")
QUESTION = "struct<" + ",".join(f"{c}:string" for c in _TEXTS) + ",allowed_video_ids:array<string>,comparison_show:boolean,comparison_video_ids:array<string>,compare_table_show:boolean,compare_table_video_ids:array<string>,task_video_map:array<struct<video_ids:array<string>>>,video_similarity_notes:map<string,string>>"
OVERRIDES = f"paper string, source_doc string, note string, questions map<string,{QUESTION}>"
LINKS = "map<string,struct<doc_id:string,url:string>>"
MANIFEST = "folder string, paper string, created_at string, note string, files map<string,struct<name:string,size:bigint>>"


def read_overrides(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per paper and question number (``qnum``) with the fields of the override. Of several files for a paper the last by path counts.
    Files hold one paper each, or with ``lines`` one a line."""
    files = spark.read.schema(OVERRIDES).json(path, multiLine=not lines).withColumn("_path", F.input_file_name()).where(F.coalesce("paper", F.lit("")) != "")
    last = files.withColumn("_n", F.row_number().over(Window.partitionBy("paper").orderBy(F.desc("_path")))).where("_n = 1")
    return last.select("paper", F.explode("questions").alias("q", "o")).select("paper", F.col("q").try_cast("int").alias("qnum"), "o.*")


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """``(title, doc_id, url)``."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", LINKS)).alias("title", "l"))
    return raw.select("title", "l.doc_id", "l.url")


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """The relation of matches as a JSON array, with an explicit schema; missing fields are null."""
    kinds = "match_id string, question_id string, paper string, qnum int, primary_type string, video_id string, video_name string, score double, hit_reason string, reject_reason string, review_reason string, final_show boolean"
    return spark.read.schema(kinds).json(path, multiLine=True)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Intake manifests, newest first."""
    return spark.read.schema(MANIFEST).option("pathGlobFilter", "intake.json").option("recursiveFileLookup", "true").json(path, multiLine=True).orderBy(F.desc("created_at"), "folder")


def pick(spark: SparkSession, real: str, sample: str) -> str:
    """The path of the real data if it is there, else of the sample."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(real)
    return real if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) else sample
