"""Line dedup by distinct-site spread, with built-in functions only.

Each line's sites are counted by HyperLogLog sketches that merge in a map-side combined aggregate. Lines whose estimate lies near the
threshold are counted again exactly. A line that stands on many sites is boilerplate: its first occurrence stays, all others go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import materialize

#: A line on so many sites is boilerplate, whatever its length and however the documents spread over the sites.
MIN_SITES = 4
#: 2^12 buckets: a standard error of about 1.6 %.
LOG_BUCKETS = 12
#: Estimates within this share of the threshold, six standard errors, are counted exactly.
NEAR = 0.1


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _bare(line: Column) -> Column:
    """The line without blanks, tabs and returns at its ends."""
    return F.regexp_replace(line, r"^[ \t\r]+|[ \t\r]+$", "")


def _keys(line: Column) -> list[Column]:
    """96 bits of hash stand for a line."""
    return [F.xxhash64(line).alias("k"), F.hash(line, F.lit(7)).alias("k2")]


def _exploded(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text_key, pos, line). The text is hashed and split below the explode, once and not once a line."""
    split = docs.select("doc_id", "source", F.xxhash64("text").alias("text_key"), _lines(F.col("text")).alias("lines"))
    return split.select("doc_id", "source", "text_key", F.posexplode("lines").alias("pos", "line"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR) -> DataFrame:
    """(k, k2, n_sites, first) of the lines on min_sites sites or more; first is their least (doc_id, text_key, line number).

    n_sites is exact near the bar and the sketch's estimate beyond it.
    """
    lines = _exploded(docs.where("source IS NOT NULL"))
    lines = lines.withColumn("line", _bare(F.col("line"))).where("line <> ''")
    lines = lines.select("doc_id", "text_key", "pos", "source", *_keys(F.col("line")))
    about = F.hll_sketch_estimate(F.hll_sketch_agg("source", LOG_BUCKETS))
    sketched = lines.groupBy("k", "k2").agg(about.alias("about"), F.min(F.struct("doc_id", "text_key", "pos")).alias("first"))
    # A line needs two sites or more in any case: the bulk of the lines ends here.
    spread = materialize(sketched.where(F.col("about") >= min_sites * (1 - near)), "spread")
    close = spread.where(F.col("about") <= min_sites * (1 + near)).select("k", "k2")
    exact = lines.join(close, ["k", "k2"]).select("k", "k2", "source").distinct().groupBy("k", "k2").agg(F.count("*").alias("exact"))
    n_sites = F.coalesce("exact", "about")
    return spread.join(exact, ["k", "k2"], "left").where(n_sites >= min_sites).select("k", "k2", n_sites.alias("n_sites"), "first")


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR) -> DataFrame:
    """docs with the text freed from boilerplate lines, and n_lines and n_removed.

    The first occurrence of a boilerplate line, by doc_id, then text hash and place, stays. Blank lines and lines of rows without a source are
    never boilerplate. Null texts stay null with no line removed; repeated rows lose or keep the same lines; an empty table gives an
    empty table; columns other than doc_id, source and text pass unread, but for n_lines and n_removed, which are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    common = materialize(boilerplate(docs.select("doc_id", "source", "text"), min_sites, near), "boilerplate")
    lines = _exploded(docs.where("source IS NOT NULL"))
    lines = lines.select("doc_id", "text_key", "pos", *_keys(_bare(F.col("line"))))
    # Written first: then the join reads plain exchanges on both sides, and a line on very many rows is split.
    again = lines.join(common, ["k", "k2"]).where(~F.struct("doc_id", "text_key", "pos").eqNullSafe(F.col("first")))
    gone = again.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("gone")).withColumnRenamed("doc_id", "gone_id")
    key = F.xxhash64("d.text")
    both = docs.alias("d").join(gone.alias("g"), (key == F.col("g.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("g.gone_id")) & F.col("d.source").isNotNull(), "left")
    parts = F.split("d.text", "\n", -1)
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "g.gone"), lambda i: F.get(parts, i)), "\n")
    out = [F.when(F.col("g.gone").isNull(), F.col("d.text")).otherwise(kept).alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns]
    n_lines = F.when(F.col("d.text").isNull(), 0).otherwise(F.size(parts)).cast("long")
    return both.select(*out, n_lines.alias("n_lines"), F.coalesce(F.size("g.gone"), F.lit(0)).cast("long").alias("n_removed"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, source, pos, line, regexp_replace(line, '^[ \t\r]+|[ \t\r]+$', '', 'g') AS bare
  FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), b AS (
  SELECT bare, min((doc_id, pos)) AS first FROM l WHERE bare <> '' AND source IS NOT NULL GROUP BY bare HAVING count(DISTINCT source) >= 4
), k AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (b.bare IS NULL OR l.source IS NULL OR (l.doc_id, l.pos) = b.first) AS text, count(*) AS n_lines,
    count(*) FILTER (NOT (b.bare IS NULL OR l.source IS NULL OR (l.doc_id, l.pos) = b.first)) AS n_removed
  FROM l LEFT JOIN b USING (bare) GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.text, '') AS text, d.lang, d.source, d.n_chars, k.n_lines, k.n_removed FROM documents d JOIN k USING (doc_id)
"""
