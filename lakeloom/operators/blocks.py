"""Blocks of texts that must not be cut, cuts around them, and chunks found again in their text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A formula in a line of its own, a picture, a row of a table.
FORMULA = r"^\s*(\$\$[^\n]+\$\$|\$[^$\n]+\$)\s*$"
IMAGE = r"!\[[^\]]*\]\([^)]+\)"
ROW = r"^\s*\|.*\|\s*$"
#: Letters of a piece of plain text at most; share of a text that its chunks may miss; letters of a chunk that can be found at least.
SIZE, MISSED, FINDABLE = 1000, 0.02, 2


def typed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, i, line, kind, block): every line of a text with its kind (text, table, formula, image, code) and block.

    Fences of three backticks and formulas between lines of two dollars run on to their other end, or to the end of the text. Neighbouring lines of a kind are
    one block, but each fence and each such formula is one of its own.
    """
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "line"))
    own = Window.partitionBy("doc_id").orderBy("i")
    bare = F.trim(F.regexp_replace("line", r"\s", " "))
    fence = F.startswith(bare, F.lit("```")).cast("int")
    lines = lines.withColumn("bare", bare).withColumn("fence", fence).withColumn("fences", F.sum(fence).over(own))
    # The closing line has an even number itself; it still belongs to its fence.
    code = (F.col("fences") % 2 == 1) | (F.col("fence") == 1)
    dollars = F.when(~code & (F.col("bare") == "$$"), 1).otherwise(0)
    lines = lines.withColumn("code", code).withColumn("dollar", dollars).withColumn("dollars", F.sum(dollars).over(own))
    formula = (F.col("dollars") % 2 == 1) | (F.col("dollar") == 1)
    kind = (
        F.when(F.col("code"), "code").when(formula | F.rlike("line", F.lit(FORMULA)), "formula").when(F.rlike("line", F.lit(IMAGE)), "image").when(F.rlike("line", F.lit(ROW)), "table").otherwise("text")
    )
    run = F.when(F.col("code"), F.ceil(F.col("fences") / 2)).when(formula, -F.ceil(F.col("dollars") / 2)).otherwise(0)
    lines = lines.withColumn("kind", kind).withColumn("run", run)
    fresh = ~(F.col("kind").eqNullSafe(F.lag("kind").over(own)) & F.col("run").eqNullSafe(F.lag("run").over(own)))
    return lines.withColumn("block", F.sum(fresh.cast("int")).over(own).cast("int")).select("doc_id", "i", "line", "kind", "block")


def atomic_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block, kind, start, content): the blocks of a text in order; their contents, joined by line ends, are the text."""
    lines = typed_lines(docs)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    found = lines.groupBy("doc_id", "block").agg(F.first("kind").alias("kind"), text.alias("content"))
    own = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return found.select("doc_id", "block", "kind", F.coalesce(F.sum(F.length("content") + 1).over(own), F.lit(0)).alias("start"), "content")


def pieces(text: Column, size: int = SIZE) -> Column:
    """A text cut behind white space into pieces of so many letters at most, or within a longer word; nothing is lost."""
    return F.regexp_extract_all(text, F.lit(rf"((?s).{{1,{size - 1}}}(?:\s|\z)|.{{1,{size}}})"), 1)


def atomic_chunks(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, block, part, kind, start, content): blocks that must not be cut whole, however long they are, and plain text in pieces."""
    found = atomic_blocks(docs)
    parts = F.when(F.col("kind") == "text", pieces(F.col("content"), size)).otherwise(F.array("content"))
    cut = found.select("doc_id", "block", "kind", "start", F.posexplode(parts).alias("part", "content"))
    own = Window.partitionBy("doc_id", "block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("start") + F.coalesce(F.sum(F.length("content")).over(own), F.lit(0))
    return cut.select("doc_id", "block", "part", "kind", start.alias("start"), "content")


def _bare(text: str) -> tuple[str, list[int]]:
    """The text with each run of white space as one blank and none at its ends; where each of its letters stands in the text."""
    out, at, blank = [], [], None
    for i, c in enumerate(text):
        if c.isspace():
            blank = i if blank is None else blank
            continue
        if blank is not None and out:
            out.append(" ")
            at.append(blank)
        blank = None
        out.append(c)
        at.append(i)
    return "".join(out), at


def located(chunks: DataFrame, docs: DataFrame, findable: int = FINDABLE) -> DataFrame:
    """(doc_id, chunk_index, start, end): where each chunk stands in its document, whatever its white space; null ends where it doesn't.

    Chunks are looked for in order, each behind the one before, and from the start if it isn't there. chunks: (doc_id, chunk_index, content); docs:
    (doc_id, text). Ends are letters of the text itself. Chunks too short to be found have null ends.
    """
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (chunks, "chunk_index"))]
    lists = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("chunks"))
    both = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(lists, "doc_id").select("doc_id", "text", "chunks")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc, text, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                bare, at = _bare(text)
                seen = 0
                for p in parts:
                    want = " ".join((p["content"] or "").split())
                    place = -1
                    if len(want) >= findable:
                        place = bare.find(want, seen)
                        place = bare.find(want) if place < 0 else place
                    if place < 0:
                        rows.append((doc, p["chunk_index"], None, None))
                    else:
                        seen = place + len(want)
                        rows.append((doc, p["chunk_index"], at[place], at[seen - 1] + 1))
            names = ["doc_id", "chunk_index", "start", "end"]
            kinds = [b.schema.field(0).type, b.schema.field(2).type.value_type.field(0).type, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], names)

    return both.mapInArrow(find, f"doc_id {kinds[0]}, chunk_index {kinds[1]}, start long, end long")


def missed(spans: DataFrame, docs: DataFrame, tolerance: float = MISSED) -> DataFrame:
    """(doc_id, n_letters, n_missed, n_gaps, ok): letters but white space of a text, those in no span, the runs of them, and whether few enough are missed."""
    own = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = spans.where("start IS NOT NULL").withColumn("reach", F.coalesce(F.max("end").over(own), F.lit(0)))
    gaps = reach.where("start > reach").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("reach").alias("a"), F.col("start").alias("b"))).alias("gaps"))
    ends = reach.groupBy("doc_id").agg(F.max("end").alias("last"))
    text = F.coalesce("text", F.lit(""))
    both = docs.select("doc_id", text.alias("text")).join(gaps, "doc_id", "left").join(ends, "doc_id", "left")
    n = F.length("text")
    last = F.coalesce("last", F.lit(0)).cast("long")
    tail = F.when(n > last, F.array(F.struct(last.alias("a"), n.cast("long").alias("b")))).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))
    all_gaps = F.concat(F.coalesce("gaps", F.array().cast("array<struct<a:bigint,b:bigint>>")), tail)
    bare = lambda t: F.length(F.regexp_replace(t, r"\s", ""))
    counts = F.transform(all_gaps, lambda g: bare(F.substring("text", (g["a"] + 1).cast("int"), (g["b"] - g["a"]).cast("int"))))
    real = F.filter(counts, lambda x: x > 0)
    out = both.select("doc_id", bare("text").cast("long").alias("n_letters"), F.aggregate(real, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_missed"), F.size(real).cast("long").alias("n_gaps"))
    return out.withColumn("ok", F.col("n_missed") <= F.col("n_letters") * tolerance)
