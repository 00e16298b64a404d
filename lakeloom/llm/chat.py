"""Chat formatting: logged snapshots of a growing conversation collapse into the longest one, with built-in functions only.

Every turn gets a rolling fingerprint of all turns up to it: the xor of hashes of (place, role, text), which adds up over blocks of turns,
so even one conversation with a third of all turns is dealt over many tasks. A conversation whose last fingerprint is an inner one of
another is a prefix of it and is dropped by an anti-join; of equal ones the least conv_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import materialize

#: Turn numbers of one block.
BLOCK = 64
#: Turns rendered into one segment.
SEGMENT = 64


def fingerprints(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, place, h1, h2): turns in order, each with its place from 1 and the fingerprint of all up to it."""
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Ties are ordered by role and text, so equal conversations stay equal; null turns come first.
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))))
    own = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.row_number().over(own))
    sizes = rows.groupBy("conv_id", "block").count().withColumn("skip", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    placed = rows.join(materialize(sizes, "blocks"), ["conv_id", "block"]).withColumn("place", F.col("skip") + F.col("at"))
    placed = placed.withColumn("t1", F.xxhash64("place", "role", "text")).withColumn("t2", F.xxhash64(F.lit("second"), "text", "place", "role"))
    placed = materialize(placed.drop("at", "skip"), "turns")
    sums = placed.groupBy("conv_id", "block").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    sums = sums.select("conv_id", "block", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(c) for c in ("s1", "s2")])
    run = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    both = placed.join(materialize(sums, "sums"), ["conv_id", "block"])
    h = [F.col(s).bitwiseXOR(F.bit_xor(t).over(run)).alias(n) for n, s, t in (("h1", "s1", "t1"), ("h2", "s2", "t2"))]
    return both.select("conv_id", "turn", "role", "text", "place", *h)


def maximal(prints: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are no prefix of a longer one and the least of their equals."""
    last = prints.groupBy("conv_id").agg(F.max(F.struct("place", "h1", "h2")).alias("l")).select("conv_id", "l.*")
    last = materialize(last, "last")
    same = ["place", "h1", "h2"]
    inner = prints.select("conv_id", *same).join(last.select("conv_id", F.col("place").alias("size")), "conv_id").where("place < size")
    inner = materialize(inner.select(*same).distinct(), "inner")
    least = last.groupBy(*same).agg(F.min("conv_id").alias("conv_id"))
    return least.join(inner, same, "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def render(prints: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, segment, text): the turns of each conversation in a role-tagged template, so many turns to a segment."""
    line = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n"))
    cut = prints.select("conv_id", F.floor((F.col("place") - 1) / segment).alias("segment"), F.struct("place", line.alias("line")).alias("x"))
    return cut.groupBy("conv_id", "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "").alias("text"))


def format_conversations(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, segment, n_turns, text) of the maximal conversations of turns(conv_id, turn, role, text).

    Turns without a conv_id belong to no conversation and are dropped; null roles and texts count as empty. Repeated turns are turns of
    their own. An empty table gives no rows; other columns are not read.
    """
    prints = materialize(fingerprints(turns), "prints")
    best = materialize(maximal(prints), "maximal")
    return render(prints.join(best.select("conv_id"), "conv_id"), segment).join(best, "conv_id").select("conv_id", "segment", "n_turns", "text")


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, count(*) AS n, string_agg(role || chr(1) || text || chr(2), '' ORDER BY place) AS whole FROM t GROUP BY conv_id
), p AS (
  SELECT conv_id, place, string_agg(role || chr(1) || text || chr(2), '') OVER (PARTITION BY conv_id ORDER BY place) AS part FROM t
), inn AS (SELECT DISTINCT part FROM p JOIN c USING (conv_id) WHERE place < n
), best AS (SELECT min(conv_id) AS conv_id, any_value(n) AS n_turns FROM c WHERE NOT EXISTS (SELECT 1 FROM inn WHERE inn.part = c.whole) GROUP BY whole)
SELECT conv_id, (place - 1) // 64 AS segment, n_turns, string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY place) AS text
FROM t JOIN best USING (conv_id) GROUP BY ALL
"""
