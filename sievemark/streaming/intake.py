"""New papers as a stream: files that arrive are tagged as they come, and counted by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievemark.operators import labels as L

SCHEMA = "question_id string, paper string, stem string, has_visual boolean, imported_at timestamp"


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of questions in ``path`` as a stream."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_seen(questions: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each question once, however often it is delivered within ``delay``; state older than that is dropped."""
    return questions.withWatermark("imported_at", delay).dropDuplicatesWithinWatermark(["question_id"])


def tagged(questions: DataFrame) -> DataFrame:
    """Type, difficulty and evidence source of each question; row by row, so the same for a stream and a table."""
    q = L.prepare(questions, "stem").withColumn("question_type", L.question_type())
    return q.select("question_id", "paper", "imported_at", "question_type", L.difficulty(F.col("question_type")).alias("difficulty"), L.evidence_source(F.col("has_visual")).alias("evidence_source"))


def counts_by_window(labels: DataFrame, delay: str = "2 hours", width: str = "1 day") -> DataFrame:
    """Questions by type and window of arrival; late ones count until the watermark has passed their window."""
    g = labels.withWatermark("imported_at", delay).groupBy(F.window("imported_at", width), "question_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("starts"), "question_type", "n")


def start(labels: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the stream to Parquet files at ``path``, exactly once, until what is there is done."""
    return labels.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
