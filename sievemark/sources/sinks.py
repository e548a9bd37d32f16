"""Where relations go: JSON exports, dense CSV, batches for an append API, one document per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.operators.sequences import batches


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; null fields stay in, so that every row has the same fields."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header and exactly ``columns``; nulls as empty cells."""
    df.select(*columns).fillna("").write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def payloads(df: DataFrame, fields: list[str], order: list[str], size: int = 200) -> DataFrame:
    """``(batch, payload)``: rows in batches of ``size`` as JSON ``{fields, rows}``, for an API that takes lists."""
    cells = F.array(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    placed = batches(df.select(*dict.fromkeys([*fields, *order])), [F.asc(c) for c in order], size)
    rows = placed.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("place", cells.alias("cells")))).alias("r"))
    return rows.select("batch", F.to_json(F.struct(F.array(*map(F.lit, fields)).alias("fields"), F.col("r.cells").alias("rows"))).alias("payload"))


def write_documents(df: DataFrame, path: str, group: str, body: str) -> None:
    """One text file per group, in a folder of its name; done again, it replaces those groups only."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.select(F.col(body).alias("value"), F.col(group)).write.mode("overwrite").partitionBy(group).text(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def is_done(df_path_marker: str, spark) -> bool:  # noqa: ANN001
    """Whether a sink has already been written completely (its success marker is there)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{df_path_marker}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
