"""Readers: files of documents become rows (path, text) or typed blocks. Spark lists and reads the files; small helpers parse one file in a task."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.chunking import heading_level


def sniff(name: Column, content: Column) -> Column:
    """Format by extension, else by the first bytes."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring(content, 1, 4))
    known = F.when(ext.isin("md", "markdown"), "markdown").when(ext.isin("htm", "html"), "html").when(ext.isin("csv", "tsv", "txt", "docx", "xlsx", "pdf", "json"), ext)
    return F.coalesce(known, F.when(head.startswith("25504446"), "pdf").when(head == "504B0304", "zip").when(F.is_valid_utf8(content.cast("string")) & ~F.contains(F.hex(F.substring(content, 1, 512)), F.lit("00")), "txt").otherwise("binary"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, content) of every file below path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", sniff(F.col("path"), F.col("content")).alias("format"), "content")


def _parsed(rows: DataFrame, parse: Callable[[bytes], str]) -> DataFrame:
    """(path, text, error): a file that can't be parsed gives its error and no text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, c in zip(b["path"], b["content"], strict=True):
                try:
                    out.append((p, parse(bytes(c)), None))
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    out.append((p, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    return rows.select("path", "content").mapInPandas(run, "path string, text string, error string")


def _pipe(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    line = lambda r: "| " + " | ".join([*(c.replace("|", "/").replace("\n", " ").strip() for c in r), *[""] * (width - len(r))]) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])]) if rows else ""


def csv_text(content: bytes) -> str:
    """A pipe table of a delimited file; the delimiter is the commonest of , ; and tab in its first line."""
    text = content.decode("utf-8-sig")
    first = text.split("\n", 1)[0]
    mark = max(",;\t", key=first.count)
    return _pipe([r for r in csv.reader(io.StringIO(text), delimiter=mark) if any(c.strip() for c in r)])


def xlsx_text(content: bytes) -> str:
    """A pipe table for each sheet, under its number as a heading."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in s.iter(f"{space}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        out = []
        for k, n in enumerate(sheets, 1):
            rows = []
            for r in ElementTree.fromstring(z.read(n)).iter(f"{space}row"):
                cells: list[str] = []
                for c in r.iter(f"{space}c"):
                    at = 0
                    for ch in re.match("[A-Z]+", c.get("r", "A"))[0]:
                        at = at * 26 + ord(ch) - 64
                    value = c.find(f"{space}v")
                    text = "".join(t.text or "" for t in c.iter(f"{space}t")) if c.get("t") == "inlineStr" else "" if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text or ""
                    cells += [""] * (at - 1 - len(cells)) + [text]
                if any(cells):
                    rows.append(cells)
            out.append(f"# Sheet {k}\n\n{_pipe(rows)}")
    return "\n\n".join(out)


def docx_text(content: bytes) -> str:
    """Paragraphs, headings as #, and tables as pipe tables, in order."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    out = []
    for e in body if body is not None else []:
        if e.tag == f"{w}tbl":
            out.append(_pipe([[words(c) for c in r.iter(f"{w}tc")] for r in e.iter(f"{w}tr")]))
        elif e.tag == f"{w}p" and words(e).strip():
            style = e.find(f"{w}pPr/{w}pStyle")
            level = re.fullmatch(r"Heading(\d)", style.get(f"{w}val", "") if style is not None else "")
            out.append(("#" * int(level[1]) + " " if level else "") + words(e))
    return "\n\n".join(out)


class _Structured(HTMLParser):
    """Headings as # and tables as pipe tables; the text of scripts and styles is kept, as any other."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.rows, self.cell, self.level = [], None, None, 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.cell = []
        elif re.fullmatch("h[1-6]", tag):
            self.level = int(tag[1])
        elif tag in ("p", "div", "br", "li", "section", "article"):
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.rows is not None:
            rows, self.rows = [r for r in self.rows if r], None
            self.out.append(f"\n{_pipe(rows)}\n")
        elif re.fullmatch("h[1-6]", tag):
            self.level = 0
            self.out.append("\n")

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)
        elif self.rows is None and data.strip():
            self.out.append(("\n" + "#" * self.level + " " if self.level else "") + " ".join(data.split()) + " ")


def html_text(content: bytes) -> str:
    parser = _Structured()
    parser.feed(content.decode("utf-8", "replace"))
    parser.close()
    return "\n".join(x for x in (line.strip() for line in "".join(parser.out).split("\n")) if x)


PARSERS: dict[str, Callable[[bytes], str]] = {
    "csv": csv_text, "tsv": csv_text, "xlsx": xlsx_text, "docx": docx_text, "html": html_text, "txt": lambda c: c.decode("utf-8-sig"), "markdown": lambda c: c.decode("utf-8-sig"),
}


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, text, error) of every file below path whose format has a parser; other formats give an error."""
    found = files(spark, path)
    parts = [_parsed(found.where(F.col("format") == k), f).withColumn("format", F.lit(k)) for k, f in PARSERS.items()]
    out = found.where(~F.col("format").isin(*PARSERS)).select("path", F.lit(None).cast("string").alias("text"), F.concat(F.lit("no parser for "), "format").alias("error"), "format")
    for p in parts:
        out = out.unionByName(p)
    return out.select("path", "format", "text", "error")


def markdown_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section_no, title, body) without the front matter."""
    from pyspark.sql import Window

    from lakeloom.operators.chunking import lines

    bare = docs.withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), r"(?s)\A---\n.*?\n---\n", ""))
    rows = lines(bare).withColumn("level", heading_level(F.col("line"))).withColumn("section_no", F.sum((F.col("level") > 0).cast("int")).over(Window.partitionBy("doc_id").orderBy("line_no")))
    title = F.max(F.when(F.col("level") > 0, F.trim(F.regexp_replace("line", r"^#{1,6}\s+", ""))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.when(F.col("level") == 0, F.col("line")).alias("line")))), lambda x: x["line"]), "\n")
    return rows.groupBy("doc_id", "section_no").agg(title.alias("title"), F.trim(body).alias("body")).where("title IS NOT NULL OR body <> ''")


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block_no, kind, content): runs of lines that are headings, pipe tables, code or text."""
    from pyspark.sql import Window

    from lakeloom.operators.chunking import lines

    own = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines(docs).withColumn("fence", F.rlike("line", F.lit(r"^\s*```")))
    inside = F.sum(F.col("fence").cast("int")).over(own) % 2 == 1
    rows = rows.withColumn("kind", F.when(F.col("fence") | inside, "CODE").when(heading_level(F.col("line")) > 0, "HEADING").when(F.rlike("line", F.lit(r"^\s*\|.*\|\s*$")), "TABLE").when(F.trim("line") == "", "BLANK").otherwise("TEXT"))
    fresh = (F.col("kind") != F.lag("kind").over(own)) | F.lag("kind").over(own).isNull() | (F.col("kind") == "HEADING")
    rows = rows.withColumn("block_no", F.sum(fresh.cast("int")).over(own)).where("kind <> 'BLANK'")
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("doc_id", "block_no").agg(F.first("kind").alias("kind"), content.alias("content"))
