"""Benchmark decontamination with built-in functions only.

Every benchmark item is cut into windows of thirteen words (an item of fewer words is one window). A window is filed under its anchor, the
word of it that is rarest in the benchmark. Documents are exploded into words; the broadcast anchors tell where windows may stand, and
the words there, joined to one string, are looked up among the windows, so only true occurrences remain. Anchors beyond one broadcast's bound
are gone through block by block, and windows beyond it are met by a shuffled join, to which a document sends a window's words and not its text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import materialize

WINDOW = 13
#: Rows of anchors that one broadcast holds, and windows that may be broadcast.
BROADCAST_ANCHORS, BROADCAST_WINDOWS = 500_000, 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words of a text; null has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP)
    return F.filter(parts, lambda w: w != "")


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, anchor, anchor_at, length, window): the distinct windows of each item, as words joined by spaces."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cut = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, size))).alias("words"))
    cut = cut.select("item_id", F.array_join("words", " ").alias("window"), F.size("words").alias("length")).distinct()
    placed = cut.select("window", "length").distinct().select("window", "length", F.posexplode(F.split("window", " ")).alias("at", "word"))
    often = items.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    rank = F.struct("n", (-F.length("word")).alias("short"), "at", "word")
    best = placed.join(often, "word").groupBy("window").agg(F.min(rank).alias("best"))
    return cut.join(best, "window").select("item_id", F.col("best.word").alias("anchor"), F.col("best.at").alias("anchor_at"), "length", "window")


def occurrences(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS, broadcast_anchors: int = BROADCAST_ANCHORS
) -> DataFrame:
    """(doc_id, text_key, start, length, item_id) for each place where a window of an item stands in a document."""
    found = materialize(windows(benchmark, size), "windows")
    anchors = found.select("anchor", "anchor_at", "length").distinct()
    blocks = max(1, -(-anchors.count() // broadcast_anchors))
    placed = docs.select("doc_id", _key(), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    placed = placed.select("doc_id", "text_key", "w", F.posexplode("w").alias("pos", "word"))
    start = F.col("pos") - F.col("anchor_at")
    fits = (F.col("word") == F.col("anchor")) & (start >= 0) & (start + F.col("length") <= F.size("w"))
    window = F.array_join(F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("length")), " ")
    parts = []
    for k in range(blocks):
        some = anchors.where(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == k) if blocks > 1 else anchors
        parts.append(placed.join(F.broadcast(some), fits).select("doc_id", "text_key", start.alias("start"), window.alias("window")))
    there = reduce(DataFrame.union, parts)
    right = found.select("item_id", "length", "window")
    right = F.broadcast(right) if found.count() <= broadcast_windows else right.hint("merge")
    return there.join(right, "window").select("doc_id", "text_key", "start", "length", "item_id")


def _key() -> Column:
    """Documents that share an id are told apart by their text."""
    return F.xxhash64("text").alias("text_key")


def covered(spans: Column) -> Column:
    """Number of positions that lie in any of the sorted (start, length) spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(acc: Column, s: Column) -> Column:
        end = (s["start"] + s["length"]).cast("long")
        fresh = F.greatest(end - F.greatest(s["start"].cast("long"), acc["end"]), F.lit(0).cast("long"))
        return F.struct((acc["n"] + fresh).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(spans, zero, add)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit spans (start, length).

    A document is contaminated if windows cover a twentieth of its words or more. Null and empty texts have no words and are clean; an
    empty benchmark hits nothing; null item texts have no windows; repeated rows each keep a row, and documents that share an id are
    judged by their own texts. Other columns of either table are not read.
    """
    docs = docs.select("doc_id", "text")
    places = occurrences(docs, benchmark.select("item_id", "text"), size)
    # A place counts once per document and item, so repeated rows of a document don't add up.
    per_item = places.groupBy("doc_id", "text_key", "item_id").agg(F.collect_set(F.struct("start", "length")).alias("s"))
    hits = per_item.groupBy("doc_id", "text_key").agg(
        F.sort_array(F.flatten(F.collect_list("s"))).alias("hit_spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    base = docs.select("doc_id", _key(), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    base, hits = base.alias("b"), hits.alias("h")
    both = base.join(hits, (F.col("b.text_key") == F.col("h.text_key")) & F.col("b.doc_id").eqNullSafe(F.col("h.doc_id")), "left")
    n_hit = F.coalesce(covered(F.col("hit_spans")), F.lit(0).cast("long"))
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return both.select(
        F.col("b.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("hit_spans", F.array().cast("array<struct<start:int,length:int>>")).alias("hit_spans"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs without the contaminated ones, all columns kept. A row stays if its doc_id and text are clean."""
    places = occurrences(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), size)
    hits = places.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"))
    n = F.size(words(F.col("d.text")))
    d = docs.alias("d")
    # Written first, so its size is known before the join is planned: texts aren't shuffled for a handful of hits.
    h = materialize(hits.select(F.col("doc_id").alias("hit_id"), "text_key", covered(F.col("spans")).alias("n_hit")), "hits").alias("h")
    on = (F.xxhash64("d.text") == F.col("h.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("h.hit_id")) & (20 * F.col("h.n_hit") >= n)
    return d.join(h, on, "left_anti").select("d.*")


#: The same result for DuckDB, by position and window text.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, list_aggregate(w[i:i + 12], 'string_agg', ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM wins
), cut AS (
  SELECT doc_id, i, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)
), occ AS (SELECT cut.doc_id, cut.i, cut.n, wins.item_id FROM cut JOIN wins USING (n, win)
), hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM occ) GROUP BY doc_id
), its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
