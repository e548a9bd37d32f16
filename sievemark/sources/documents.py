"""Word-processor files as tables of blocks, and folders of transcripts. Read on the executors by the standard library."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The name spaces of the format.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/package/2006/relationships}"
BLOCKS = "path string, ord int, kind string, text string, images array<string>, error string"


def blocks_of(content: bytes) -> list[tuple[str, str, list[str]]]:
    """``(kind, text, images)`` of each paragraph (p) and table (table) of the body, in order; images by their place in the file.

    Cells of a row are joined by " | ", rows by line breaks. Anything else in the body is left out.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        media = {}
        if "word/_rels/document.xml.rels" in z.namelist():
            for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels")).iter(f"{_P}Relationship"):
                if "media/" in r.get("Target", ""):
                    media[r.get("Id")] = r.get("Target")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out = []
    for e in body if body is not None else ():
        found = [media[i] for i in dict.fromkeys(b.get(f"{_R}embed") for b in e.iter(f"{_A}blip")) if i in media]
        if e.tag == f"{_W}p":
            out.append(("p", words(e).strip(), found))
        elif e.tag == f"{_W}tbl":
            rows = [" | ".join(words(c).strip() for c in r.iter(f"{_W}tc")) for r in e.iter(f"{_W}tr")]
            out.append(("table", "\n".join(rows), found))
    return out


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def blocks(files: DataFrame) -> DataFrame:
    """The blocks of .docx files (``path``, ``content``); a file that can't be read has one row with its ``error``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(p, i, k, t, m, None) for i, (k, t, m) in enumerate(blocks_of(content))]
                except Exception as e:  # noqa: BLE001
                    rows.append((p, 0, None, "", [], f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "ord", "kind", "text", "images", "error"])

    return files.select("path", "content").mapInPandas(parse, BLOCKS)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of all .docx files below ``path``."""
    return blocks(_files(spark, path, "*.docx"))


def media_of(blocks: DataFrame) -> DataFrame:
    """``(path, image, ord)``: each image of a document once, where it first occurs."""
    return blocks.select("path", "ord", F.explode("images").alias("image")).groupBy("path", "image").agg(F.min("ord").alias("ord"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """``(transcript_id, file_name, file_path, source_folder, parse_status, text)`` of the .doc and .docx files below ``path``.

    Paragraphs come first, then tables. Files of the old format and broken files keep an empty text and say so
    in ``parse_status``. Ids follow the order of the paths.
    """
    blocks = read_blocks(spark, path)
    parts = F.array_sort(F.collect_list(F.struct((F.col("kind") == "table").alias("last"), "ord", "text")))
    body = blocks.groupBy("path").agg(F.concat_ws("\n", F.filter(parts["text"], lambda x: x != "")).alias("text"), F.max("error").alias("error"))
    files = _files(spark, path, "*.doc*").select("path").where(F.col("path").rlike(r"\.docx?$"))
    both = files.join(body, "path", "left")
    status = F.when(F.col("path").endswith(".doc"), "unsupported format").when(F.col("error").isNotNull(), F.concat(F.lit("failed: "), F.col("error"))).otherwise("parsed")
    # a folder of files is small beside what is in them; only their paths are numbered in one place
    number = F.row_number().over(Window.orderBy("path"))
    steps = F.split("path", "/")
    return both.select(
        F.format_string("TR-%03d", number).alias("transcript_id"), F.element_at(steps, -1).alias("file_name"), F.col("path").alias("file_path"),
        F.element_at(steps, -2).alias("source_folder"), status.alias("parse_status"), F.coalesce("text", F.lit("")).alias("text"),
    )
