"""WARC archives: written by Spark's tasks, read back as a stream, and assembled into captures.

A capture is a request, a response (or a revisit of an equal payload) and a metadata record; the first and the last point at the second
through WARC-Concurrent-To, and a revisit at its response through WARC-Refers-To. Archives are files of gzip members, one for each record, that
begin with a warcinfo record; their number and size follow Spark's partitions.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import Scratch, materialize, pieces, shared_dir

END = b"\r\n\r\n"
#: Bytes after which an archive is closed and another begun.
FILE_BYTES = 256 << 20
#: Names of records are made from what they hold, in this name space.
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_id string, kind string, concurrent_to string, target_uri string, date string, refers_to string, refers_to_uri string, refers_to_date string, payload_digest string, "
    "payload_bytes long, payload string, status string, page_id long"
)


def _uri(url: str | None) -> str | None:
    """The url without what would end a header's line."""
    return None if url is None else "".join("%20" if c <= " " else c for c in url)


def _record(kind: str, block: bytes, **headers: str | None) -> bytes:
    """One record; headers are given with underscores for hyphens, and None leaves one out."""
    lines = [b"WARC/1.1", f"WARC-Type: {kind}".encode()]
    lines += [f"{k.replace('_', '-')}: {v}".encode() for k, v in headers.items() if v is not None]
    return b"\r\n".join([*lines, f"Content-Length: {len(block)}".encode()]) + END + block + END


def _urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(map(repr, parts)))}>"


def capture_records(page_id: int | None, url: str | None, html: str | None, first: tuple[int, str | None] | None, date: str) -> list[bytes]:
    """The three records of a page; first has the page_id and url of the response that holds this payload."""
    payload = (html or "").encode()
    digest = hashlib.sha1(payload).digest()
    target, own = _uri(url), _urn("b", digest, page_id, url)
    again = first is not None and first[0] != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + END
    about = "" if page_id is None else f"page-id: {page_id}"
    revisited = {"WARC_Refers_To": _urn("b", digest, *first), "WARC_Refers_To_Target_URI": _uri(first[1]), "WARC_Refers_To_Date": date, "WARC_Profile": PROFILE} if again else {}
    common = {"WARC_Target_URI": target, "WARC_Date": date}
    linked = {"WARC_Concurrent_To": own, **common}
    return [
        _record("request", f"GET {target or '/'} HTTP/1.1".encode() + END, WARC_Record_ID=_urn("a", digest, page_id, url), **linked, Content_Type="application/http; msgtype=request"),
        _record(
            "revisit" if again else "response", http if again else http + payload, WARC_Record_ID=own, WARC_Payload_Digest=f"sha1:{base64.b32encode(digest).decode()}",
            **revisited, **common, Content_Type="application/http; msgtype=response",
        ),
        _record("metadata", about.encode(), WARC_Record_ID=_urn("c", digest, page_id, url), **linked, Content_Type="application/warc-fields"),
    ]


def write_archives(pages: DataFrame, path: str, date: str = "2026-01-01T00:00:00Z") -> None:
    """Write pages(page_id, url, html) as WARC files under path, which any executor must reach.

    A null html is an empty payload and a null url a record without a target. Equal payloads: the smallest page_id is the response and the
    others revisit it; rows that repeat that page_id are responses too, and equal rows share the name of their records. An empty table makes no files. A task
    writes under a name of its attempt and gives the files their last names when it is done, so a task that runs again leaves nothing behind.
    """
    sha = F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    base = pages.select("page_id", "url", "html", sha.alias("sha"))
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = base.groupBy("sha").agg(F.min(known).alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    base = base.join(materialize(first, "payloads"), "sha", "left").select("page_id", "url", "html", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        task = TaskContext.get()
        names: list[tuple[str, str]] = []
        out, size, n = None, 0, 0
        for b in pieces(batches, 2):
            for page_id, url, html, head, head_url in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None or size > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"{folder}/part-{task.partitionId():06d}-{len(names):04d}.warc.gz"
                    names.append((f"{folder}/_{task.taskAttemptId()}-{len(names):04d}", name))
                    out, size = store.open_output_stream(names[-1][0], compression=None), 0
                    about = _record("warcinfo", b"format: WARC File Format 1.1", WARC_Record_ID=_urn("i", name), WARC_Date=date, WARC_Filename=name.rpartition("/")[2], Content_Type="application/warc-fields")
                    out.write(gzip.compress(about, 6, mtime=0))
                for record in capture_records(page_id, url, html, None if head is None else (head, head_url), date):
                    member = gzip.compress(record, 6, mtime=0)
                    size += len(member)
                    out.write(member)
                n += 1
        if out is not None:
            out.close()
        for own, name in names:
            store.move(own, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["pages"])

    materialize(base.mapInArrow(run, "pages long"), "archives")


def _fields(block: str) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.split("\r\n") if ":" in x)}


def _parsed(head: dict[str, str], block: bytes, with_payload: bool) -> dict:
    kind = head.get("warc-type", "")
    out = {"kind": kind} | {k: head.get(f"warc-{k.replace('_', '-')}") for k in ("record_id", "concurrent_to", "target_uri", "date", "refers_to")}
    if kind == "metadata":
        about = _fields(block.decode())
        return out | {"page_id": int(about["page-id"]) if "page-id" in about else None}
    if kind not in ("request", "response", "revisit"):
        return out
    http, _, payload = block.partition(END)
    out["status"] = http.split(b"\r\n")[0].decode()
    if kind == "revisit":
        out |= {"payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:"), "refers_to_uri": head.get("warc-refers-to-target-uri"), "refers_to_date": head.get("warc-refers-to-date")}
    elif kind == "response":
        out |= {"payload_bytes": len(payload), "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode()}
        if with_payload:
            out["payload"] = payload.decode("utf-8", "replace")
    return out


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record. The text reader hands a file over piece by piece; the pieces make up the stream that lengths are read from."""
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in RECORD.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = b""
        for b in pieces(batches, 0, 16 << 20):
            rest += END.join([*(x.encode() for x in b.column(0).to_pylist()), b""])
            at, out = 0, []
            while True:
                start = rest.find(b"WARC/", at)
                cut = rest.find(END, start) if start >= 0 else -1
                if cut < 0:
                    break
                head = _fields(rest[start:cut].decode())
                end = cut + len(END) + int(head["content-length"])
                if end > len(rest):
                    break
                out.append(_parsed(head, rest[cut + len(END) : end], with_payload))
                at = end
            rest = rest[at:]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if rest.strip(b"\r\n"):
            raise ValueError(f"an archive ends within a record: {rest[:80]!r}")

    return spark.read.text(path, lineSep=END.decode()).mapInArrow(run, RECORD)


def captures(found: DataFrame) -> DataFrame:
    """One nested row per response or revisit: its request and metadata joined through WARC-Concurrent-To, the response of a revisit through WARC-Refers-To.

    page_id is read from the metadata record, refers_to and a revisit's payload_bytes from the response that the header names. Records that share a name
    are alike, so the first of them stands for all where it is joined to another.
    """
    scratch = Scratch(found.sparkSession)
    found = scratch.write(found, "records")
    side = lambda kind, *more: found.where(F.col("kind") == kind).groupBy(F.col("concurrent_to").alias("record_id")).agg(F.first(F.struct(F.col("record_id").alias("name"), *more)).alias(kind))
    main = found.where("kind IN ('response', 'revisit')").drop("page_id", "concurrent_to")
    metadata = side("metadata", "page_id")
    both = main.join(side("request", "status"), "record_id", "left").join(metadata, "record_id", "left")
    # A name of a response is joined only if a revisit refers to it.
    asked = main.where("kind = 'revisit'").select(F.col("refers_to").alias("record_id")).distinct()
    responses = main.where("kind = 'response'").join(asked, "record_id").groupBy("record_id").agg(F.first("payload_bytes").alias("bytes"))
    responses = responses.join(metadata, "record_id", "left").select(F.col("record_id").alias("refers_to"), "bytes", F.col("metadata.page_id").alias("page"))
    return both.join(scratch.write(responses, "responses"), "refers_to", "left").select(
        F.col("metadata.page_id").alias("page_id"),
        F.coalesce("payload_bytes", "bytes").alias("payload_bytes"),
        "payload_digest",
        F.col("kind").alias("record_type"),
        F.col("page").alias("refers_to"),
        F.struct("record_id", "target_uri", "date", F.col("refers_to").alias("refers_to_record"), "refers_to_uri", "refers_to_date", both["status"], "payload").alias("response"),
        F.struct(F.col("request.name").alias("record_id"), F.col("request.status").alias("request_line")).alias("request"),
        F.struct(F.col("metadata.name").alias("record_id")).alias("metadata"),
    )


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages as archives, read them back and assemble the captures."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/lakeloom/warc-{uuid.uuid4().hex}"
    spark.createDataFrame([], "value string").write.mode("overwrite").text(path)  # the folder is there even if no page is
    write_archives(pages, path)
    return captures(read_records(spark, path))
