"""Readers on files made here, sinks, and streams over file sources."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lakeloom.sources import readers, sinks
from lakeloom.streaming import streams


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in files.items():
            z.writestr(n, t)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
SHEET = f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Price</t></is></c></row><row r="2"><c r="A2"><v>7</v></c></row></sheetData></worksheet>'


def test_documents(spark, tmp_path):
    made = {
        "a.csv": b"x;y\n1;2\n", "b.md": b"---\nt: 1\n---\nintro\n# One\nbody", "c.html": b"<h2>Head</h2><p>text</p><table><tr><th>k</th></tr><tr><td>v</td></tr></table>", "d.docx": _zip({"word/document.xml": DOCX}),
        "e.xlsx": _zip({"xl/worksheets/sheet1.xml": SHEET, "xl/sharedStrings.xml": f"<sst {S}><si><t>Name</t></si></sst>"}), "f.docx": b"broken", "g.bin": b"\x00\xff\x00", "h": b"plain text", "i.pdf": b"%PDF-1.4",
    }
    for n, c in made.items():
        (tmp_path / n).write_bytes(c)
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.documents(spark, str(tmp_path)).collect()}
    assert got["a.csv"].text == "| x | y |\n| --- | --- |\n| 1 | 2 |"
    assert got["c.html"].text.startswith("## Head\ntext") and "| k |\n| --- |\n| v |" in got["c.html"].text
    assert got["d.docx"].text == "## Title\n\nBody\n\n| a | b |\n| --- | --- |"
    assert got["e.xlsx"].text == "# Sheet 1\n\n| Name |  | Price |\n| --- | --- | --- |\n| 7 |  |  |"
    assert got["f.docx"].text is None and "BadZipFile" in got["f.docx"].error
    assert got["g.bin"].error == "no parser for binary" and got["h"].text == "plain text" and got["i.pdf"].format == "pdf"
    d = spark.createDataFrame([(1, made["b.md"].decode())], "doc_id int, text string")
    assert [(r.title, r.body) for r in readers.markdown_sections(d).orderBy("section_no").collect()] == [(None, "intro"), ("One", "body")]
    b = spark.createDataFrame([(1, "# H\ntext\nmore\n\n| a |\n| b |\n```\n# code\n```")], "doc_id int, text string")
    assert [r.kind for r in readers.blocks(b).orderBy("block_no").collect()] == ["HEADING", "TEXT", "TABLE", "CODE"]


def test_replace_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "doc int, v string"), path, "doc")
    sinks.replace_partitions(spark.createDataFrame([(2, "B")], "doc int, v string"), path, "doc")
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == ["B", "a"]


@pytest.fixture
def events(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(i, "u", at(t), f"m{i % 3}", f"p{i % 2}") for i, t in enumerate([0, 1, 2, 3, 11, 12, 70, 71])]
    path = str(tmp_path / "events")
    spark.createDataFrame(rows, "event_id long, user string, ts timestamp, msg string, page string").write.parquet(path)
    return spark.readStream.schema("event_id long, user string, ts timestamp, msg string, page string").parquet(path), str(tmp_path)


def _run(df, base, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{base}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_stream_dedup(events):
    df, base = events
    assert len(_run(streams.dedup(df, "msg"), base, "deduped")) == 3


def test_stream_distinct(events):
    df, base = events
    got = {r.window.start.second + 60 * r.window.start.minute: (r.n_distinct, r.n) for r in _run(streams.tumbling_distinct(df, "page", "user"), base, "distinct_pages", "complete")}
    assert got == {0: (2, 6), 60: (2, 2)}


def test_stream_sliding_limit(events):
    df, base = events
    got = sorted((r.event_id, r.allowed, r.used) for r in _run(streams.sliding_limit(df, "user", 2, 10), base, "limited", "update"))
    # Denied calls leave no trace: at 11 s the call of 0 s is out of the window and that of 1 s is in it.
    assert [a for _, a, _ in got] == [True, True, False, False, True, True, True, True]


def test_relay_writes_dead_letters(spark, events):
    df, base = events
    seen = []

    def handle(batch, batch_id):
        seen.append(batch.count())
        return batch.where("event_id < 2").select(F.col("msg").alias("payload"), (F.col("event_id") + 5).cast("int").alias("attempts"))

    streams.relay(df, f"{base}/relay", handle, f"{base}/dead").awaitTermination(120)
    assert sum(seen) == 8 and spark.read.json(f"{base}/dead").count() == 2


def test_lifecycle_and_expiry(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = spark.createDataFrame([(1, t(1), "DRAFT"), (1, t(3), "active"), (2, t(2), "DRAFT")], "doc_id int, ts timestamp, state string")
    assert {r.doc_id: r.state for r in streams.lifecycle(rows).collect()} == {1: "active", 2: "DRAFT"}
    cache = spark.createDataFrame([(1, t(1)), (2, t(9)), (3, None)], "id int, expires_at timestamp")
    assert sorted(r.id for r in streams.expire(cache, "2024-01-05").collect()) == [2, 3]
