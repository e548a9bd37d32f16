import io
import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sievemark.sources import documents, overrides, sheets, sinks
from sievemark.streaming import intake


def docx(paragraphs, table=None, image=None):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    if image:
        body += '<w:p><w:r><a:blip r:embed="rId1"/></w:r></w:p>'
    if table:
        body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in table) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}<w:sectPr/></w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="media/i.png"/></Relationships>')
    return out.getvalue()


def test_documents(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.docx").write_bytes(docx(["1. 题", ""], [["c", "d"], ["e", "f"]], image=True))
    (tmp_path / "a" / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "a" / "old.doc").write_bytes(b"old")
    (tmp_path / "a" / "n.txt").write_text("no")
    b = documents.read_blocks(spark, str(tmp_path)).orderBy("path", "ord").collect()
    assert [(r.kind, r.text, r.images) for r in b if r.error is None] == [("p", "1. 题", []), ("p", "", []), ("p", "", ["media/i.png"]), ("table", "c | d\ne | f", [])]
    t = {r.file_name: r for r in documents.read_transcripts(spark, str(tmp_path)).collect()}
    assert t["x.docx"].text == "1. 题\nc | d\ne | f" and t["x.docx"].parse_status == "parsed" and t["x.docx"].source_folder == "a"
    assert t["bad.docx"].parse_status.startswith("failed") and t["old.doc"].parse_status == "unsupported format" and t["bad.docx"].text == ""
    assert sorted(r.transcript_id for r in t.values()) == ["TR-001", "TR-002", "TR-003"]


def test_sheets(spark, tmp_path):
    rows = [{"row_number": 1, "values": {"A": "名", "C": "图", "AA": "图"}}, {"row_number": 2, "values": {"A": " x ", "C": "k", "AA": " "}}]
    (tmp_path / "r.json").write_text(json.dumps({"ok": True, "data": {"rows": rows}}))
    df = sheets.read_rows(spark, str(tmp_path / "r.json"), "s")
    found = sheets.columns_titled(df, "图")
    assert found == ["C", "AA"]
    got = sheets.body_rows(df).select(sheets.cell("A").alias("a"), sheets.cell("Z").alias("z"), sheets.references(found).alias("r")).collect()
    assert [tuple(r) for r in got] == [("x", "", ["C:k", "AA:图"])]
    (tmp_path / "bad.json").write_text(json.dumps({"ok": False}))
    with pytest.raises(Exception, match="failed to load"):
        sheets.read_rows(spark, str(tmp_path / "bad.json"), "s").collect()
    part = [{"type": "img", "token": "t1", "width": 3, "height": 4}, {"type": "text", "text": "hi"}]
    (tmp_path / "m.json").write_text(json.dumps({"ok": True, "data": {"start_row": 1, "cells": [{"row": 2, "col": "C", "parts": part}]}}))
    m = sheets.read_media(spark, str(tmp_path / "m.json"), "s").first()
    assert (m.col, [t.token for t in m.tokens], m.texts) == ("C", ["t1"], ["hi"])


def test_overrides(spark, tmp_path):
    for n, p in (("a_v5.json", "allow"), ("b_v5.json", "exclude")):
        (tmp_path / n).write_text(json.dumps({"paper": "P", "questions": {"14": {"promotion": p, "allowed_video_ids": ["V1"]}, "x": {}}}))
    got = {r.qnum: r for r in overrides.read_overrides(spark, str(tmp_path / "*_v5.json")).collect()}
    assert got[14].promotion == "exclude" and got[14].allowed_video_ids == ["V1"] and None in got
    (tmp_path / "l.json").write_text(json.dumps({"P": {"doc_id": "d", "url": "u"}}))
    assert tuple(overrides.read_links(spark, str(tmp_path / "l.json")).first()) == ("P", "d", "u")
    (tmp_path / "m.json").write_text(json.dumps([{"match_id": "a__b", "qnum": 3, "score": 0.5, "final_show": True}]))
    assert overrides.read_matches(spark, str(tmp_path / "m.json")).first().qnum == 3
    for n, t in (("one", "2030-01-01"), ("two", "2030-02-01")):
        (tmp_path / n).mkdir()
        (tmp_path / n / "intake.json").write_text(json.dumps({"folder": n, "created_at": t}))
    assert [r.folder for r in overrides.read_manifests(spark, str(tmp_path)).collect()] == ["two", "one"]
    assert overrides.pick(spark, str(tmp_path / "none"), "sample") == "sample"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 2 else f"v{i}") for i in range(5)], "k int, v string")
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 5 and sinks.is_done(str(tmp_path / "j"), spark)
    sinks.write_csv(df, str(tmp_path / "c"), ["v", "k"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["v", "k"]
    p = sinks.payloads(df, ["k", "v"], ["k"], 2).orderBy("batch").collect()
    assert json.loads(p[0].payload) == {"fields": ["k", "v"], "rows": [["0", "v0"], ["1", ""]]} and len(p) == 3
    docs = spark.createDataFrame([("a", "<x>"), ("b", "<y>")], "g string, body string")
    sinks.write_documents(docs, str(tmp_path / "d"), "g", "body")
    sinks.write_documents(docs.where("g = 'a'").withColumn("body", F.lit("<z>")), str(tmp_path / "d"), "g", "body")
    assert {tuple(r) for r in spark.read.text(str(tmp_path / "d")).collect()} == {("<z>", "a"), ("<y>", "b")}


def test_stream(spark, tmp_path):
    rows = [("q1", "p", "如图工艺流程", True, datetime(2030, 1, 1)), ("q1", "p", "如图工艺流程", True, datetime(2030, 1, 2)), ("q2", "p", "读pH曲线", False, datetime(2030, 1, 1))]
    spark.createDataFrame(rows, intake.SCHEMA).write.parquet(str(tmp_path / "in"))
    s = intake.tagged(intake.first_seen(intake.read_stream(spark, str(tmp_path / "in"))))
    intake.start(s, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert {(r.question_id, r.question_type) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("q1", "工艺流程题"), ("q2", "选择题图像题")}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    intake.start(s, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    table = intake.tagged(spark.createDataFrame(rows, intake.SCHEMA))
    assert intake.counts_by_window(table).count() == 3
