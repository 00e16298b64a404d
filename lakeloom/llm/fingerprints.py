"""Document fingerprints by threshold-scaled sketches, with built-in functions only.

A sketch keeps every shingle hash below a fixed share of all hashes, so its size grows with the text, and sketches of a very short and a very
long document still speak of the same hashes: the share of one's that the other holds estimates containment. Sketches merge by union. So that
a short text isn't left without a hash, the least FLOOR hashes are kept in any case; two sketches are compared below the lower of
the bounds up to which each is complete.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.contamination import words

#: Words of a shingle; hashes that are kept in any case.
SIZE, FLOOR = 5, 64
#: Hashes are sixteen hexadecimal digits; those that sort before BELOW, a sixteenth of all, are kept.
BELOW, DIGITS = "1", 16
#: Ranges of doc_id for each shuffle partition, so that partitions hold about as much.
RANGES = 4


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def hashes(text: Column, size: int = SIZE) -> Column:
    """The hash of each run of so many words; of fewer words, of all; none for a text without words."""

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1)))
        found = F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, size), " ").cast("binary")), 1, DIGITS))
        return F.when(F.size(w) > 0, found).otherwise(F.array().cast("array<string>"))

    return _let(words(text), cut)


def kept(found: Column, below: str = BELOW, floor: int = FLOOR) -> Column:
    """The sketch of hashes: sorted, those before the bound and the least ones in any case. The bound is shorter than a hash."""

    def least(h: Column) -> Column:
        low = F.array_distinct(F.filter(h, lambda x: x < below))
        return _let(low, lambda d: F.when(F.size(d) >= floor, F.sort_array(d)).otherwise(F.slice(F.sort_array(F.array_distinct(h)), 1, floor)))

    return _let(found, least)


def sketch(text: Column, size: int = SIZE, below: str = BELOW, floor: int = FLOOR) -> Column:
    return kept(hashes(text, size), below, floor)


def merged(a: Column, b: Column, below: str = BELOW, floor: int = FLOOR) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return kept(F.array_union(a, b), below, floor)


def bound(s: Column, below: str = BELOW, floor: int = FLOOR) -> Column:
    """No hash up to here is missing in the sketch: one with fewer hashes than the floor is complete."""
    return F.when(F.size(s) < floor, F.lit("g")).otherwise(F.greatest(F.lit(below), F.element_at(s, -1)))


def overlap(a: Column, b: Column, below: str = BELOW, floor: int = FLOOR) -> Column:
    """(n_a, n_b, n_common): hashes of either sketch and of both, up to the lower bound of the two."""

    def count(top: Column) -> Column:
        x, y = F.filter(a, lambda h: h <= top), F.filter(b, lambda h: h <= top)
        return F.struct(F.size(x).alias("n_a"), F.size(y).alias("n_b"), F.size(F.array_intersect(x, y)).alias("n_common"))

    return _let(F.least(bound(a, below, floor), bound(b, below, floor)), count)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds; null where a has no hash to judge by."""
    return _let(overlap(a, b), lambda o: F.try_divide(o["n_common"].cast("double"), o["n_a"].cast("double")))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; null where neither has a hash to judge by."""
    return _let(overlap(a, b), lambda o: F.try_divide(o["n_common"].cast("double"), (o["n_a"] + o["n_b"] - o["n_common"]).cast("double")))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of the smaller one's shingles that the other holds; 1 for equal sketches, 0 where there is no hash to judge by."""
    share = _let(overlap(a, b), lambda o: F.try_divide(o["n_common"].cast("double"), F.least(o["n_a"], o["n_b"]).cast("double")))
    return F.when(a == b, 1.0).otherwise(F.coalesce(share, F.lit(0.0)))


def with_next(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, Window]:
    """(rows, window): docs dealt into ranges of key with a column next_text, the text of the row that follows in descending order.

    Rows of one key follow each other by text, those without a key come last, and the first row follows the last. The rows with the least key of a
    range stand at the head of the range below once more, where their successor is; the column answers tells on which copy the
    answer is. So texts are sent once, by range, and no task sees more than a few ranges.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * RANGES)
    least = docs.select(key).repartitionByRange(n, key).groupBy(F.spark_partition_id()).agg(F.min(F.struct(key)).alias("low"))
    lows = sorted((r["low"][key] for r in least.collect()), key=lambda x: (x is not None, x)) or [None]
    m, side = len(lows), max(1, int(len(lows) ** 0.5))
    kind = docs.schema[key].dataType
    many = lambda values, depth: F.lit(values).cast(f"{depth * 'array<'}{kind.simpleString()}{depth * '>'}")
    rest = [lows[i : i + side] for i in range(1, m, side)]

    def count(part: Column) -> Column:
        return F.size(F.filter(part, lambda x: x <= F.col(key)))

    if rest:  # the range by two short searches: among the first bounds of runs, then in the run
        run = count(many([r[0] for r in rest], 1))
        at = F.when(run > 0, (run - 1) * side + count(F.element_at(many(rest, 2), F.greatest(run, F.lit(1))))).otherwise(0)
    else:
        at = F.lit(0)
    placed = docs.withColumn("_range", at.cast("int"))
    low = F.col(key).eqNullSafe(F.element_at(many(lows, 1), F.col("_range") + 1))
    place = lambda r, head, answers: F.struct(r.alias("range"), F.lit(head).alias("head"), answers.alias("answers"))
    own, below = place(F.col("_range"), 0, ~low), place((F.col("_range") + (m - 1)) % m, 1, F.lit(True))
    placed = placed.withColumn("_at", F.explode(F.when(low, F.array(own, below)).otherwise(F.array(own)))).drop("_range")
    placed = placed.select("*", "_at.range", "_at.head", "_at.answers").drop("_at")
    window = Window.partitionBy("range").orderBy(F.desc("head"), F.desc_nulls_last(key), "text")
    return placed.withColumn("next_text", F.lead("text").over(window)), window


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_hashes) for each row of docs.

    The edited text has its last half from the start of the next document in descending order of doc_id; the next one of the last is the first, so a
    single document's next is itself. Null texts count as empty. An empty text, or one without words, has the empty fingerprint; two
    such are alike. Rows that share a doc_id follow each other by text, rows without one come last; repeated rows each give a row.
    An empty table gives none. Other columns are not read.
    """
    rows, window = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left(F.coalesce("next_text", F.lit("")), half))
    rows = rows.select("doc_id", "text", "range", "head", "answers", n.cast("long").alias("n_chars"), edited.alias("edited"))
    own = rows.select("*", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("text")).alias("s"), sketch(F.col("edited")).alias("e")).drop("edited")
    both = own.withColumn("next_s", F.lead("s").over(window)).where("answers")
    return both.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("s", "").alias("fingerprint"), F.array_join("e", "").alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("e")).alias("near_edited"), likeness(F.col("s"), F.col("next_s")).alias("near_next"), F.size("s").cast("long").alias("n_hashes"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER o, first_value(coalesce(text, '')) OVER o) AS next_text
  FROM documents WINDOW o AS (ORDER BY doc_id DESC)
), x AS (
  SELECT doc_id, text, length(text) AS n, left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited FROM d
), w AS (
  SELECT doc_id, kind, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda v: v <> '') AS w
  FROM (SELECT doc_id, 's' AS kind, text FROM x UNION ALL SELECT doc_id, 'e', edited FROM x)
), h AS (
  SELECT doc_id, kind, CASE WHEN len(w) > 0 THEN list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: left(md5(array_to_string(w[i:i + 4], ' ')), 16)))) ELSE [] END AS h FROM w
), k AS (
  SELECT doc_id, kind, CASE WHEN len(list_filter(h, lambda v: v < '1')) >= 64 THEN list_filter(h, lambda v: v < '1') ELSE h[1:64] END AS k FROM h
), b AS (SELECT doc_id, kind, k, CASE WHEN len(k) < 64 THEN 'g' ELSE greatest('1', k[-1]) END AS top FROM k
), j AS (
  SELECT s.doc_id, s.k AS sk, e.k AS ek, least(s.top, e.top) AS e_top, s.top AS s_top, lead(s.k) OVER o AS later_k, first_value(s.k) OVER o AS first_k, lead(s.top) OVER o AS later_top, first_value(s.top) OVER o AS first_top
  FROM b s JOIN b e ON s.doc_id = e.doc_id AND s.kind = 's' AND e.kind = 'e' WINDOW o AS (ORDER BY s.doc_id DESC)
), n AS (
  SELECT doc_id, sk, ek, list_filter(sk, lambda v: v <= e_top) AS a, list_filter(ek, lambda v: v <= e_top) AS b, coalesce(later_k, first_k) AS nk, least(s_top, coalesce(later_top, first_top)) AS n_top FROM j
), m AS (SELECT *, list_filter(sk, lambda v: v <= n_top) AS c, list_filter(nk, lambda v: v <= n_top) AS d FROM n)
SELECT x.doc_id, n AS n_chars, sha256(edited) AS edited_sha256, array_to_string(sk, '') AS fingerprint, array_to_string(ek, '') AS edited_fingerprint,
  CASE WHEN sk = ek THEN 1.0 WHEN least(len(a), len(b)) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / least(len(a), len(b)) END::DOUBLE AS near_edited,
  CASE WHEN sk = nk THEN 1.0 WHEN least(len(c), len(d)) = 0 THEN 0.0 ELSE len(list_intersect(c, d)) / least(len(c), len(d)) END::DOUBLE AS near_next, len(sk) AS n_hashes
FROM x JOIN m USING (doc_id)
"""
