"""Readers and chunkers as Spark knows them: a data source for spark.read.format and table functions for SQL."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow.fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

from lakeloom.sources.readers import PARSERS

#: Bytes of files that a task reads, about; bytes of a file's head that tell its format.
PARTITION_BYTES, HEAD = 64 << 20, 512
EXTENSIONS = {"md": "markdown", "markdown": "markdown", "htm": "html", "html": "html", "csv": "csv", "tsv": "tsv", "docx": "docx", "xlsx": "xlsx", "pdf": "pdf", "json": "json"}
BLANKS = " \t\n\r\f"
#: What a zip file holds that tells its kind.
OFFICE = (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx"))


def kind_of(path: str, content: bytes) -> str:
    """The format by extension, else by the first bytes; zip files by what they hold."""
    name = path.rsplit("/", 1)[-1].lower()
    known = EXTENSIONS.get(name.rsplit(".", 1)[-1]) if "." in name else None
    head = content[:HEAD]
    if known and not (known in ("docx", "xlsx") and head[:4] != b"PK\x03\x04"):
        return known
    if head.startswith(b"%PDF"):
        return "pdf"
    if head.startswith(b"PK\x03\x04"):
        import io

        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                names = z.namelist()
        except zipfile.BadZipFile:
            return "zip"
        return next((kind for start, kind in OFFICE if any(n.startswith(start) for n in names)), "zip")
    if head.lstrip().lower().startswith((b"<!doctype html", b"<html")):
        return "html"
    if b"\x00" in head:
        return "binary"
    try:
        content.decode("utf-8")
    except UnicodeDecodeError:
        return "binary"
    return "txt"


class Files(InputPartition):
    def __init__(self, root: str, paths: list[str]):
        self.root, self.paths = root, paths


class DocumentReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> list[InputPartition]:
        """Files in order of their names, so many to a partition that it holds about so many bytes."""
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")
        found = [f for f in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
        out, paths, size = [], [], 0
        for f in sorted(found, key=lambda f: f.path):
            if paths and size + f.size > self.most:
                out.append(Files(self.path, paths))
                paths, size = [], 0
            paths.append(f.path)
            size += f.size
        return [*out, Files(self.path, paths)] if paths or not out else out

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(partition.root if ":" in partition.root else f"file://{partition.root}")
        for path in partition.paths:
            with fs.open_input_stream(path) as f:
                content = f.read()
            kind = kind_of(path, content)
            text, error = None, None
            if kind not in PARSERS:
                error = f"no parser for {kind}"
            else:
                try:
                    text = PARSERS[kind](content)
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    error = f"{type(e).__name__}: {e}"
            yield path, kind, text, error


class DocumentSource(DataSource):
    """spark.read.format("documents").load(folder): (path, format, text, error) of every file below it."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "path string, format string, text string, error string"

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)))


@udtf(returnType="doc_id bigint, part int, content string")
class ChunkText:
    """chunk_text(TABLE docs[, size]): the texts of docs(doc_id, text) in pieces of so many letters at most, cut behind white space."""

    def eval(self, row: Row, size: int = 1000):
        text, at, part = row["text"] or "", 0, 0
        while at < len(text):
            end = min(len(text), at + size)
            if len(text) - at >= size:
                cut = next((i for i in range(end, at + 1, -1) if text[i - 1] in BLANKS), 0)
                end = cut or end
            yield row["doc_id"], part, text[at:end]
            at, part = end, part + 1


@udtf(returnType="doc_id bigint, section int, level int, title string, body string")
class MarkdownSections:
    """markdown_sections(TABLE docs): the sections of docs(doc_id, text) by their # headings; what stands before the first has none."""

    def eval(self, row: Row):
        title, level, body, n = None, 0, [], 0
        for line in [*(row["text"] or "").split("\n"), None]:
            bare = line.lstrip("#") if line is not None else ""
            marks = len(line) - len(bare) if line is not None else 0
            if line is None or (1 <= marks <= 6 and bare.startswith(" ")):
                if title is not None or "".join(body).strip(BLANKS):
                    yield row["doc_id"], n, level, title, "\n".join(body).strip(BLANKS)
                    n += 1
                if line is not None:
                    title, level, body = bare.strip(BLANKS), marks, []
            else:
                body.append(line)


def register(spark: SparkSession) -> None:
    """Make the source and the table functions known to a session, by name."""
    spark.dataSource.register(DocumentSource)
    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("markdown_sections", MarkdownSections)
