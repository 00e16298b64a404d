"""Tables in texts: pipe tables become rows, rows become priced entities and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.numbers import money
from lakeloom.operators.chunking import lines

RULE = r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$"
#: Header words that tell what a column holds.
ROLES = {
    "name": r"(?i)\b(name|item|product|service|title|tên|dịch vụ|sản phẩm)\b",
    "price": r"(?i)(price|cost|amount|fee|giá|đơn giá)",
    "category": r"(?i)(category|type|group|loại|nhóm)",
}


def cells(line: Column) -> Column:
    """Trimmed cells of a pipe row."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|", -1), lambda c: F.trim(c))


def pipe_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, table_no, row_no, header, cells): the rows of each run of pipe lines; the first is the header and rule lines are left out."""
    own = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines(docs).withColumn("pipe", F.rlike("line", F.lit(r"^\s*\|.*\|\s*$")))
    starts = F.col("pipe") & ~F.coalesce(F.lag("pipe").over(own), F.lit(False))
    rows = rows.withColumn("table_no", F.sum(starts.cast("int")).over(own)).where("pipe").where(~F.rlike("line", F.lit(RULE)))
    part = Window.partitionBy("doc_id", "table_no").orderBy("line_no")
    rows = rows.withColumn("n", F.row_number().over(part)).withColumn("header", F.first(cells(F.col("line"))).over(part))
    return rows.where("n > 1").select("doc_id", "table_no", (F.col("n") - 1).alias("row_no"), "header", cells(F.col("line")).alias("cells"))


def entities(rows: DataFrame, least: int = 10_000, most: int = 500_000_000) -> DataFrame:
    """(doc_id, table_no, row_no, name, category, price_primary, price_secondary, attributes) from pipe rows by the header's words.

    Without a name column the first cell is the name; prices outside the bounds don't count; other columns are attributes.
    """
    pairs = F.arrays_zip(F.col("header").alias("h"), F.col("cells").alias("c"))
    of = lambda role: F.transform(F.filter(pairs, lambda p: F.rlike(p["h"], F.lit(ROLES[role])) & (p["c"] != "")), lambda p: p["c"])
    roles = "|".join(f"(?:{p})" for p in ROLES.values())
    others = F.filter(pairs, lambda p: ~F.rlike(p["h"], F.lit(roles)) & (F.coalesce(p["c"], F.lit("")) != "") & (F.coalesce(p["h"], F.lit("")) != ""))
    prices = F.filter(F.transform(of("price"), lambda c: money(c, least, most)), lambda v: v.isNotNull())
    first = lambda a: F.get(a, F.lit(0))
    unique = F.filter(others, lambda p, i: ~F.exists(F.slice(others, 1, i), lambda q: q["h"] == p["h"]))
    return rows.select(
        "doc_id", "table_no", "row_no", F.coalesce(first(of("name")), first(F.col("cells"))).alias("name"), first(of("category")).alias("category"), first(prices).alias("price_primary"), F.get(prices, F.lit(1)).alias("price_secondary"),
        F.map_from_arrays(F.transform(unique, lambda p: p["h"]), F.transform(unique, lambda p: p["c"])).alias("attributes"),
    ).where("name <> ''")


def narrate(rows: DataFrame) -> DataFrame:
    """One sentence per row: each header with its cell."""
    pairs = F.filter(F.arrays_zip(F.col("header").alias("h"), F.col("cells").alias("c")), lambda p: (p["h"] != "") & (p["c"] != ""))
    return rows.select("doc_id", "table_no", "row_no", F.concat(F.array_join(F.transform(pairs, lambda p: F.concat(p["h"], F.lit(": "), p["c"])), "; "), F.lit(".")).alias("sentence"))


def header_quality(rows: DataFrame) -> DataFrame:
    """By table: blank and repeated header cells, and whether a name and a price column are told."""
    one = rows.groupBy("doc_id", "table_no").agg(F.first("header").alias("header"), F.count("*").alias("rows"))
    has = lambda role: F.exists("header", lambda h: F.rlike(h, F.lit(ROLES[role])))
    filled = F.filter("header", lambda h: h != "")
    return one.select("doc_id", "table_no", "rows", (F.size("header") - F.size(filled)).alias("blank"), (F.size(filled) - F.size(F.array_distinct(filled))).alias("repeated"), has("name").alias("has_name"), has("price").alias("has_price"))
