"""Sources: one contract over files, object stores, databases and REST replies."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date, datetime
from io import BytesIO
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.nested import records_of
from ..session import scratch
from ..streaming.incremental import after_cursor

IDENTIFIER = re.compile(r"^[A-Za-z_一-鿿][\w一-鿿]*(\.[A-Za-z_一-鿿][\w一-鿿]*)?$")


def identifier(name: str) -> str:
    if not IDENTIFIER.match(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


@dataclass
class Connector:
    """test, resources, sample, full and delta of one source."""

    config: dict = field(default_factory=dict)

    def resources(self, spark: SparkSession) -> list[str]:
        raise NotImplementedError

    def full(self, spark: SparkSession, resource: str) -> DataFrame:
        raise NotImplementedError

    def test(self, spark: SparkSession) -> bool:
        try:
            self.resources(spark)
            return True
        except Exception:  # noqa: BLE001
            return False

    def sample(self, spark: SparkSession, resource: str, rows: int = 100) -> DataFrame:
        return self.full(spark, resource).limit(rows)

    def delta(self, spark: SparkSession, resource: str, wm: str, pk: str, cursor: tuple | None = None, overlap: str | None = None) -> DataFrame:
        """Rows behind the cursor, in the order of watermark and key."""
        return after_cursor(self.full(spark, resource), identifier(wm), identifier(pk), cursor, overlap).orderBy(wm, pk)


class SqlConnector(Connector):
    """A database over JDBC, read in ranges of ``partition_column`` where bounds are given."""

    def _reader(self, spark: SparkSession):
        r = spark.read.format("jdbc").option("url", self.config["url"])
        for k in ("driver", "user", "password", "fetchsize"):
            if k in self.config:
                r = r.option(k, self.config[k])
        return r

    def resources(self, spark: SparkSession) -> list[str]:
        q = self.config.get("list_query", "select table_name from information_schema.tables")
        return [r[0] for r in self._reader(spark).option("query", q).load().collect()]

    def full(self, spark: SparkSession, resource: str) -> DataFrame:
        saved = self.config.get("saved_queries", {}).get(resource)
        r = self._reader(spark)
        p = self.config.get("partition")
        if p and not saved:
            r = r.option("partitionColumn", identifier(p["column"])).option("lowerBound", p["lower"]).option("upperBound", p["upper"]).option("numPartitions", p["parts"])
        return (r.option("query", saved) if saved else r.option("dbtable", identifier(resource))).load()


class FileConnector(Connector):
    """A folder; the kind of a file follows from its extension."""

    def resources(self, spark: SparkSession) -> list[str]:
        return sorted(r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.config["path"]).select("path").collect())

    def full(self, spark: SparkSession, resource: str) -> DataFrame:
        return read_file(spark, resource)


class RestConnector(Connector):
    """Pages of records fetched by ``fetch(resource, page)``, a function of the configuration, until an empty or a short page without ``next``.

    Pages are written to the shared folder in parts of ``pages_per_part``, so
    the driver never holds more than one part. All pages are followed; a
    configured ``max_pages`` is a guard that raises when there are more.
    """

    def full(self, spark: SparkSession, resource: str) -> DataFrame:
        return self._pages(spark, lambda k: self.config["fetch"](resource, k))

    def delta(self, spark: SparkSession, resource: str, wm: str, pk: str, cursor: tuple | None = None, overlap: str | None = None) -> DataFrame:
        """Records behind the cursor, with their watermark and key; with ``fetch_since(resource, page, cursor)`` in the configuration the service leaves out the others.

        The types of the two are those of the cursor, or given as ``types``; else they are compared as text.
        """
        since = self.config.get("fetch_since")
        rows = self._pages(spark, lambda k: since(resource, k, cursor)) if since and cursor else self.full(spark, resource)
        known = {int: "bigint", float: "double", datetime: "timestamp", date: "date"}
        kinds = {c: self.config.get("types", {}).get(c) or known.get(type(v), "string") for c, v in zip((wm, pk), cursor or (None, None))}
        rows = rows.select(*[F.try_variant_get("record", f"$.{identifier(c)}", k).alias(c) for c, k in kinds.items()], "record")
        return after_cursor(rows, identifier(wm), identifier(pk), cursor, overlap).orderBy(wm, pk)

    def _pages(self, spark: SparkSession, fetch) -> DataFrame:
        size, most, part = self.config.get("page_size", 100), self.config.get("max_pages"), self.config.get("pages_per_part", 1000)
        path, pages, k = scratch(spark), [], 0
        while True:
            k += 1
            if most and k > most:
                raise ValueError(f"more than {most} pages; raise max_pages")
            text, n, more = fetch(k)
            pages.append((text,))
            last = n == 0 or (n < size and not more)
            if last or len(pages) == part:
                spark.createDataFrame(pages, "value string").write.mode("append").parquet(path)
                pages = []
            if last:
                return records_of(spark.read.schema("value string").parquet(path), "value", self.config.get("data_path"))

    def resources(self, spark: SparkSession) -> list[str]:
        return list(self.config.get("resources", []))


REGISTRY: dict[str, type[Connector]] = {"sql": SqlConnector, "postgres": SqlConnector, "postgresql": SqlConnector, "mysql": SqlConnector, "jdbc": SqlConnector, "file": FileConnector, "storage": FileConnector, "rest": RestConnector, "rest_api": RestConnector}


def connector(kind: str, config: dict) -> Connector:
    if kind.lower() not in REGISTRY:
        raise ValueError(f"unknown connector {kind!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[kind.lower()](config)


KINDS = {"structured": ("csv", "tsv", "xlsx", "parquet", "orc"), "semi": ("json", "jsonl", "xml", "yaml"), "unstructured": ("md", "txt", "pdf", "docx", "doc", "pptx", "ppt", "html")}


def kind_of(name: str) -> str:
    e = name.rsplit(".", 1)[-1].lower()
    return next((k for k, es in KINDS.items() if e in es), "unstructured")


def read_csv(spark: SparkSession, path: str, sep: str = ",", columns: list[str] | None = None) -> DataFrame:
    """All columns as text; byte-order marks, quoted separators and doubled quotes are read as such."""
    r = spark.read.option("header", columns is None).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).option("ignoreLeadingWhiteSpace", False)
    df = (r.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])) if columns else r.option("inferSchema", False)).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return spark.read.option("multiLine", not lines).json(path)


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Records under ``row_tag``; attributes lose the mark the reader gives them."""
    df = spark.read.option("rowTag", row_tag).xml(path)
    return df.toDF(*[c[1:] if c.startswith("_") and c != "_VALUE" and c[1:] not in df.columns else c for c in df.columns])


def sheet_rows(data: bytes) -> list[list[str]]:
    """Rows of the first sheet of an XLSX file, from its XML parts."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheet = sorted(n for n in z.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml$", n))[0]
        out = []
        for row in ET.fromstring(z.read(sheet)).iter(f"{{{ns['m']}}}row"):
            cells: dict[int, str] = {}
            for k, c in enumerate(row.findall("m:c", ns)):
                ref = re.match(r"[A-Z]+", c.get("r", ""))
                at = k
                if ref:
                    at = 0
                    for ch in ref[0]:
                        at = at * 26 + ord(ch) - 64
                    at -= 1
                v = c.find("m:v", ns)
                text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
                cells[at] = shared[int(text)] if c.get("t") == "s" and text else text
            out.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        return out


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Cells of XLSX files as ``path, row, cells`` (map of column to text); blank headers become ``col_<i>``. One task per file."""

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for p, b in zip(pdf["path"], pdf["content"]):
                rows = sheet_rows(b)
                head = [h.strip() or f"col_{i}" for i, h in enumerate(rows[0])] if rows else []
                out += [(p, i, dict(zip(head, [*r, *[""] * (len(head) - len(r))]))) for i, r in enumerate(rows[1:], 1)]
            yield pd.DataFrame(out, columns=["path", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, row int, cells map<string,string>")


def decoded(data: bytes) -> str:
    """UTF-8, else GB 18030; never with replacement characters."""
    for enc in ("utf-8-sig", "gb18030"):
        try:
            return data.decode(enc)
        except UnicodeDecodeError:
            continue
    raise ValueError("neither UTF-8 nor GB 18030")


def _office_text(data: bytes) -> str:
    """Paragraphs of DOCX and slides of PPTX files; headings as Markdown, table rows with bars."""
    w, a = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/drawingml/2006/main}"
    with zipfile.ZipFile(BytesIO(data)) as z:
        names = z.namelist()
        if "word/document.xml" in names:
            out = []
            body = ET.fromstring(z.read("word/document.xml")).find(f"{w}body")
            for el in body if body is not None else []:
                if el.tag == f"{w}p":
                    t = "".join(x.text or "" for x in el.iter(f"{w}t"))
                    s = el.find(f"{w}pPr/{w}pStyle")
                    m = re.match(r"(?i)heading ?(\d)", s.get(f"{w}val", "") if s is not None else "")
                    if t.strip():
                        out.append(("#" * int(m[1]) + " " if m else "") + t)
                elif el.tag == f"{w}tbl":
                    rows = [["".join(x.text or "" for x in c.iter(f"{w}t")) for c in r.iter(f"{w}tc")] for r in el.iter(f"{w}tr")]
                    out += [f"| {' | '.join(r)} |" + ("\n|" + "---|" * len(r) if k == 0 else "") for k, r in enumerate(rows)]
            return "\n\n".join(out)
        slides = sorted((n for n in names if re.match(r"ppt/slides/slide\d+\.xml$", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        return "\n\n".join(f"## Slide {k}\n\n" + "\n".join("".join(x.text or "" for x in p.iter(f"{a}t")) for p in ET.fromstring(z.read(n)).iter(f"{a}p")) for k, n in enumerate(slides, 1))


#: Converters by extension, for kinds that need a model or a library (``pdf``, images): data and name to Markdown.
CONVERTERS: dict[str, Callable[[bytes, str], str]] = {}


def to_markdown(data: bytes, name: str) -> str:
    e = name.rsplit(".", 1)[-1].lower()
    if e in CONVERTERS:
        return CONVERTERS[e](data, name)
    if e in ("docx", "pptx"):
        return _office_text(data)
    text = decoded(data)
    if e in ("csv", "tsv"):
        import csv

        rows = list(csv.reader(text.splitlines(), delimiter="\t" if e == "tsv" else ","))
        return "\n".join(f"| {' | '.join(r)} |" + ("\n|" + "---|" * len(r) if k == 0 else "") for k, r in enumerate(rows))
    if e in ("html", "xml"):
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"<[^>]+>", "\n", re.sub(r"(?is)<(script|style).*?</\1>", "", text))).strip()
    return text


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``path, markdown_text, error`` of every file below a path; a file that can't be read has an error and no text."""

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for p, b in zip(pdf["path"], pdf["content"]):
                try:
                    out.append((p, to_markdown(b, p), None))
                except Exception as e:  # noqa: BLE001
                    out.append((p, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["path", "markdown_text", "error"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(parse, "path string, markdown_text string, error string")


def read_file(spark: SparkSession, path: str, row_tag: str = "record") -> DataFrame:
    e = path.rsplit(".", 1)[-1].lower()
    if e in ("csv", "tsv"):
        return read_csv(spark, path, "\t" if e == "tsv" else ",")
    if e in ("json", "jsonl"):
        return read_json(spark, path, e == "jsonl")
    if e == "xml":
        return read_xml(spark, path, row_tag)
    if e in ("parquet", "orc"):
        return spark.read.format(e).load(path)
    return read_xlsx(spark, path) if e == "xlsx" else read_documents(spark, path)
