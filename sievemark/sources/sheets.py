"""Spreadsheet exports as JSON: rows of cells by column letter, and cells with images and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.functions.text import column_number, text

ROWS = "ok boolean, data struct<rows:array<struct<row_number:int,values:map<string,string>>>>"
CELL = "array<struct<type:string,text:string,token:string,width:int,height:int>>"
MEDIA = f"ok boolean, truncated boolean, data struct<start_row:int,cells:array<struct<row:int,col:string,parts:{CELL}>>>"


def read_rows(spark: SparkSession, path: str, source: str, lines: bool = False) -> DataFrame:
    """``(source, row_number, values)``; fails on a file whose ``ok`` isn't true. Files hold one read each, or with ``lines`` one a line."""
    raw = spark.read.schema(ROWS).json(path, multiLine=not lines)
    checked = raw.withColumn("rows", F.when(F.col("ok"), F.col("data.rows")).otherwise(F.raise_error(F.concat(F.lit("failed to load "), F.input_file_name())).cast("array<struct<row_number:int,values:map<string,string>>>")))
    return checked.select(F.lit(source).alias("source"), F.explode("rows").alias("r")).select("source", "r.row_number", F.col("r.values").alias("values"))


def cell(column: str) -> Column:
    """A cell's trimmed text, or ""."""
    return F.trim(text(F.col("values")[column]))


def columns_titled(rows: DataFrame, title: str, header_row: int = 1) -> list[str]:
    """The columns whose header cell is ``title``, in spreadsheet order."""
    keys = F.map_keys(F.map_filter("values", lambda _, v: F.trim(v) == title))
    found = rows.where(F.col("row_number") == header_row).select(F.explode(keys).alias("c"))
    return [r["c"] for r in found.distinct().orderBy(column_number(F.col("c"))).collect()]


def body_rows(rows: DataFrame, header_row: int = 1) -> DataFrame:
    """The rows below the header."""
    return rows.where(F.col("row_number") > header_row)


def references(columns: list[str], label: str = "图") -> Column:
    """``col:text`` for each of the columns that is filled; a cell of blanks has ``label``."""
    items = F.array(*[F.when(F.col("values")[c].isNotNull(), F.concat(F.lit(f"{c}:"), F.coalesce(F.nullif(cell(c), F.lit("")), F.lit(label)))) for c in columns])
    return F.array_compact(items)


def read_media(spark: SparkSession, path: str, source: str) -> DataFrame:
    """``(source, row, col, tokens, texts)``: images and texts of rich cells; fails on a truncated read."""
    raw = spark.read.schema(MEDIA).json(path, multiLine=True)
    bad = ~F.coalesce("ok", F.lit(False)) | F.coalesce("truncated", F.lit(False))
    checked = raw.withColumn("cells", F.when(bad, F.raise_error(F.lit("truncated or failed read")).cast(f"array<struct<row:int,col:string,parts:{CELL}>>")).otherwise(F.col("data.cells")))
    one = checked.select(F.explode("cells").alias("c"))
    images = F.transform(F.filter("c.parts", lambda p: p["token"].isNotNull()), lambda p: F.struct(p["token"].alias("token"), p["width"].alias("width"), p["height"].alias("height")))
    texts = F.transform(F.filter("c.parts", lambda p: text(p["text"]) != ""), lambda p: p["text"])
    return one.select(F.lit(source).alias("source"), "c.row", "c.col", images.alias("tokens"), texts.alias("texts"))


def with_references(rows: DataFrame, columns: list[str], label: str = "图") -> DataFrame:
    """``rows`` with ``refs`` (see ``references``), only those that have any."""
    return rows.withColumn("refs", references(columns, label)).where(F.size("refs") > 0)


def columns_between(columns: list[str]) -> tuple[str, str] | None:
    """The first and the last of the columns in spreadsheet order; None without columns."""
    ordered = sorted(columns, key=lambda c: (len(c), c))
    return (ordered[0], ordered[-1]) if ordered else None
