"""Table regions of texts, with their surroundings, as chunks of rows and of whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from lakeloom.functions.text import BLANK

#: Commas and filled cells of a table's line at least; lines of a region at least; sampled rows of a chunk with surroundings; letters of a line that
#: make surroundings worth a chunk; letters of such a chunk and of a group of rows at most.
COMMAS, FILLED, LINES, SAMPLE, WORTH, MOST, GROUP = 1, 2, 2, 3, 30, 1500, 4000
#: Texts whose lines are Python objects at once.
AT_ONCE = 200


def _told(line: str) -> bool:
    return line.strip(BLANK) != ""


def _read(text: str | None) -> list[tuple[str, int | None, int | None, int | None, str | None]]:
    """(line, region, gap, row, header) of the lines of a text that aren't blank; row is null for those of a region without data."""
    lines = [x for x in (text or "").split("\n") if _told(x)]
    cells = [x.split(",") for x in lines]
    shapes = [len(c) if len(c) > COMMAS and sum(x.strip(" ") != "" for x in c) >= FILLED else 0 for c in cells]
    header = next((x for x, shape in zip(lines, shapes, strict=True) if shape), None)
    out, n = [], 0
    for shape, run in groupby(range(len(lines)), shapes.__getitem__):
        at = list(run)
        if not shape or len(at) < LINES:
            out += [(lines[i], None, n, None, header) for i in at]
            continue
        n, row = n + 1, 0
        for i in at:
            data = lines[i] != header and lines[i].strip(BLANK + ",") != ""
            row += data
            out.append((lines[i], n, None, row if data else None, header))
    return out


def _by_text(docs: DataFrame, f: Callable[[str | None], Iterator[tuple]], columns: str) -> DataFrame:
    """(doc_id, columns): the rows that f gives for each text."""
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL(columns)])
    names, kinds = schema.names, [pa.int32() if isinstance(x.dataType, IntegerType) else pa.string() for x in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(i, AT_ONCE)
                rows = [(n, *r) for n, text in enumerate(b.column(1).to_pylist()) for r in f(text)]
                of, *rest = zip(*rows, strict=True) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *(pa.array(x, k) for x, k in zip(rest, kinds[1:], strict=True))], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def table_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, i, line, region, gap, row, header): each line that isn't blank with its region and its row there, or else the number of regions before it, and its document's header.

    A region is two lines or more with equally many commas and two filled cells each; the header is the first such line of the document, wherever
    it stands, for regions needn't begin with one. The header and lines without data have no row. A document is read whole, so nothing is sorted or shuffled.
    """
    found = _by_text(docs, lambda text: ((i, *x) for i, x in enumerate(_read(text))), "i int, line string, region int, gap int, row int, header string")
    return found.select("doc_id", "i", "line", "region", "gap", "row", "header")


def data_rows(lines: DataFrame) -> DataFrame:
    """(doc_id, region, row, header, line): the regions' rows without the header and rows without data, numbered from 1."""
    return lines.where("row IS NOT NULL").select("doc_id", "region", "row", "header", "line")


def row_chunks(rows: DataFrame) -> DataFrame:
    """(doc_id, region, row, content): each row under the header."""
    return rows.select("doc_id", "region", "row", F.concat_ws("\n", "header", "line").alias("content"))


@F.pandas_udf(ArrayType(IntegerType()))
def packed(sizes: pd.Series, header: pd.Series, most: pd.Series) -> pd.Series:
    """For each row of a table the group that it falls into, in order, under so many letters; a last row alone joins the group before."""

    def groups(lengths, head, limit) -> list[int]:
        out, n, used = [], 0, head
        for i, size in enumerate(lengths):
            if i and used + size + 1 > limit and out[-1] == n:
                n, used = n + 1, head
            out.append(n)
            used += size + 1
        if n and out.count(n) == 1:
            out[-1] = n - 1
        return out

    return pd.Series([groups(s, h, m) for s, h, m in zip(sizes, header, most, strict=True)])


def group_chunks(rows: DataFrame, most: int = GROUP) -> DataFrame:
    """(doc_id, region, part, first_row, last_row, content): whole tables, or runs of rows that stay under so many letters, under the header.

    A row chunk belongs to the group of its region whose first and last row enclose it.
    """
    sizes = rows.groupBy("doc_id", "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", F.length("line").alias("n")))), lambda x: x["n"]).alias("sizes"), F.first("header").alias("header"))
    dealt = sizes.select("doc_id", "region", F.posexplode(packed("sizes", F.length("header"), F.lit(most))).alias("at", "part"))
    both = rows.join(dealt.withColumn("row", F.col("at") + 1), ["doc_id", "region", "row"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n")
    found = both.groupBy("doc_id", "region", "part").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.first("header").alias("header"), text.alias("lines"))
    return found.select("doc_id", "region", "part", "first_row", "last_row", F.concat_ws("\n", "header", "lines").alias("content"))


def surrounding_chunks(lines: DataFrame, rows: DataFrame, sample: int = SAMPLE, worth: int = WORTH, most: int = MOST) -> DataFrame:
    """(doc_id, region, kind, content): a region's lines before it, the header and its first rows; the header, its last rows and the lines after it.

    Lines between two regions stand in both. Only where one of the lines is long enough to tell something, and the whole not too long.
    """
    said = lines.where("gap IS NOT NULL").groupBy("doc_id", "gap").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]).alias("said"), F.max(F.length("line")).alias("longest"))
    n = F.count("*").over(Window.partitionBy("doc_id", "region"))
    ends = rows.withColumn("n", n).where((F.col("row") <= sample) | (F.col("row") > F.col("n") - sample))
    pick = lambda some: F.transform(F.array_sort(F.collect_list(F.when(some, F.struct("row", "line")))), lambda x: x["line"])
    ends = ends.groupBy("doc_id", "region").agg(F.first("header").alias("header"), pick(F.col("row") <= sample).alias("head"), pick(F.col("row") > F.col("n") - sample).alias("tail"))

    def side(gap: Column, kind: str, parts: list) -> DataFrame:
        near = ends.withColumn("gap", gap).join(said.where(F.col("longest") > worth), ["doc_id", "gap"])
        return near.select("doc_id", "region", F.lit(kind).alias("kind"), F.concat_ws("\n", *parts).alias("content")).where(F.length("content") <= most)

    return side(F.col("region") - 1, "before", ["said", "header", "head"]).unionByName(side(F.col("region"), "after", ["header", "tail", "said"]))


def surroundings(docs: DataFrame, sample: int = SAMPLE, worth: int = WORTH, most: int = MOST) -> DataFrame:
    """surrounding_chunks of the tables of documents(doc_id, text), a text a doc_id, each made where its document is read."""

    def sides(text: str | None) -> Iterator[tuple[int, str, str]]:
        said: dict[int, list[str]] = {}
        rows: dict[int, list[str]] = {}
        head = ""
        for line, region, gap, row, header in _read(text):
            if gap is not None:
                said.setdefault(gap, []).append(line)
            elif row is not None:
                rows.setdefault(region, []).append(line)
                head = header
        said = {gap: x for gap, x in said.items() if max(map(len, x)) > worth}
        for region, x in rows.items():
            near = []
            if region - 1 in said:
                near.append(("before", [*said[region - 1], head, *x[:sample]]))
            if region in said:
                near.append(("after", [head, *x[-sample:], *said[region]]))
            yield from ((region, kind, content) for kind, content in ((k, "\n".join(c)) for k, c in near) if len(content) <= most)

    return _by_text(docs.where("doc_id IS NOT NULL"), sides, "region int, kind string, content string")
