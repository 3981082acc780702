from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from loomgraph.sources import connectors as S, exports, versions


def test_csv_json_xml(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,note\n1,"x, y"\n2,"say ""hi"""\n3,\n', encoding="utf-8")
    rows = [tuple(r) for r in S.read_csv(spark, str(tmp_path / "a.csv")).orderBy("id").collect()]
    assert rows == [("1", "x, y"), ("2", 'say "hi"'), ("3", None)]
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert S.read_json(spark, str(tmp_path / "a.json")).count() == 2
    (tmp_path / "a.xml").write_text('<r><record id="7"><title>t</title></record></r>')
    assert S.read_xml(spark, str(tmp_path / "a.xml"), "record").select("id", "title").first() == (7, "t")


def test_xlsx_docx_text(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>x</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2"><v>5</v></c><c r="B2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    assert S.read_xlsx(spark, str(tmp_path / "a.xlsx")).first().cells == {"id": "5"}
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>body</w:t></w:r></w:p></w:body></w:document>')
    assert S.to_markdown((tmp_path / "d.docx").read_bytes(), "d.docx") == "# Top\n\nbody"
    assert S.decoded("中文".encode("gb18030")) == "中文"
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/t.md").write_text("# T")
    (tmp_path / "docs/bad.docx").write_bytes(b"nope")
    got = {r.path.rsplit("/", 1)[1]: r for r in S.read_documents(spark, str(tmp_path / "docs")).collect()}
    assert got["t.md"].markdown_text == "# T" and got["bad.docx"].error


def test_jdbc_delta(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.createDataFrame([(1, 10), (2, 20), (3, 20)], "id int, wm int").write.format("jdbc").option("url", url).option("dbtable", "t").save()
    c = S.connector("jdbc", {"url": url, "list_query": "select tablename from sys.systables where tabletype = 'T'"})
    assert "T" in c.resources(spark) and c.test(spark)
    assert [tuple(r) for r in c.delta(spark, "t", "wm", "id", (20, 2)).collect()] == [(3, 20)]
    assert c.sample(spark, "t", 2).count() == 2
    with pytest.raises(ValueError):
        c.full(spark, "t; drop table t")
    with pytest.raises(ValueError):
        S.connector("nothing", {})


def test_rest(spark):
    pages = {1: ('{"data": [{"a": 1}, {"a": 2}]}', 2, True), 2: ('{"data": [{"a": 3}]}', 1, False)}
    c = S.connector("rest", {"fetch": lambda r, k: pages[k], "page_size": 2})
    assert c.full(spark, "x").count() == 3
    many = lambda r, k: (f'{{"data": [{{"id": {k}, "wm": {k}}}]}}', 1, k < 130)
    c = S.connector("rest", {"fetch": many, "page_size": 2, "pages_per_part": 50})
    assert c.full(spark, "x").count() == 130  # beyond a hundred pages, until the last one
    with pytest.raises(ValueError):
        S.connector("rest", {"fetch": many, "page_size": 1, "max_pages": 20}).full(spark, "x")
    asked = []
    since = lambda r, k, cur: (asked.append(cur), (f'{{"data": [{{"id": {cur[0] + k}, "wm": {cur[0] + k}}}]}}' if k < 3 else '{"data": []}', 1 if k < 3 else 0, True))[1]
    c = S.connector("rest", {"fetch": many, "fetch_since": since, "page_size": 1})
    assert [r.id for r in c.delta(spark, "x", "wm", "id", (40, 40)).collect()] == [41, 42] and set(asked) == {(40, 40)}


def test_versions(spark, tmp_path):
    root = f"file://{tmp_path}"
    a = spark.range(3)
    assert versions.write_version(a, root, "d") == 1 and versions.write_version(a.limit(2), root, "d") == 2
    assert versions.read_version(spark, root, "d", 1).count() == 3 and versions.read_version(spark, root, "d").count() == 2
    with pytest.raises(LookupError):
        versions.read_version(spark, root, "d", 9)
    (tmp_path / "d/v=3").mkdir()  # another writer's
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        versions.write_version(a, root, "d")
    with pytest.raises(ValueError):
        versions.pinned(["d", "e"], {"d": [1]})


def test_exports(spark, tmp_path):
    e = spark.createDataFrame([("1", 'a"b', None, "T", None, None, 0.5)], "id string, name_cn string, name_en string, type string, description string, properties string, confidence double")
    r = spark.createDataFrame([("r", "1", "1", "rel", 0.9)], "id string, source_entity string, target_entity string, type string, confidence double")
    assert exports.turtle(e, r).count() == 3 and '\\"' in exports.cypher(e, r).first().line
    exports.property_graph(e, r, f"{tmp_path}/g")
    assert spark.read.option("header", True).csv(f"{tmp_path}/g/vertices").count() == 1
    y = exports.yaml(e.select("id", "name_cn", "name_en")).first().line
    assert y == '- {"id":"1","name_cn":"a\\"b"}'
    page = exports.html_report(e, r)
    assert page.startswith("<!doctype html>") and "<td>T</td><td>1</td>" in page and "<td>rel</td><td>1</td>" in page and "&lt;" in exports.html_report(e.withColumn("type", F.lit("<b>")), r)
    assert exports.as_text(spark.createDataFrame([(bytearray(b"abc"), [1])], "b binary, a array<int>")).first() == ("<3 bytes>", "[1]")
