"""Queries over the index of extracted entities: prices, superlatives, names, counts."""

from __future__ import annotations

import unicodedata
from string import ascii_lowercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks that stand after the letter in decomposed texts.
COMBINING = "".join(map(chr, range(0x300, 0x370)))

#: Attributes that only name a row.
IDENTITY = ("brand", "name", "aliases")
#: Upper bounds of the price buckets.
BUCKETS = (("under_500k", 500_000), ("under_1M", 1_000_000), ("under_2M", 2_000_000), ("under_5M", 5_000_000))
#: Latin letters with marks and what they fold to, by their decomposition; đ has none and folds to d.
MARKED = "đ" + "".join(c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c == c.lower() and unicodedata.normalize("NFD", c)[0] in ascii_lowercase)
PLAIN = "d" + "".join(unicodedata.normalize("NFD", c)[0] for c in MARKED[1:])


def fold(text: Column) -> Column:
    """Lower case without accents; a text in decomposed form loses its combining marks."""
    return F.translate(F.lower(text), MARKED + COMBINING, PLAIN)


def notation(text: Column) -> Column:
    """Lower case without a single non-digit between digits; twice, as matches don't overlap."""
    once = F.regexp_replace(F.lower(text), r"([0-9])[^0-9]([0-9])", "$1$2")
    return F.regexp_replace(once, r"([0-9])[^0-9]([0-9])", "$1$2")


def in_price_range(low: float | None = None, high: float | None = None, column: str = "any") -> Column:
    """A price from low to high. With both bounds one column must meet both of them; one bound may be met by either."""

    def one(c: str) -> Column:
        out = F.lit(True)
        if low is not None:
            out = out & (F.col(c) >= low)
        return out & (F.col(c) <= high) if high is not None else out

    if low is None and high is None:
        return F.lit(True)
    return one(f"price_{column}") if column in ("primary", "secondary") else one("price_primary") | one("price_secondary")


def value_bearing(identity: tuple[str, ...] = IDENTITY) -> Column:
    """A price, or an attribute beyond the identity with a text."""
    told = F.exists(F.map_entries("attributes"), lambda e: ~e["key"].isin(*identity) & (F.trim(e["value"]) != ""))
    return F.col("price_primary").isNotNull() | F.col("price_secondary").isNotNull() | told


def range_list(rows: DataFrame, low: float | None, high: float | None, column: str = "any", limit: int = 1000) -> DataFrame:
    return rows.where(in_price_range(low, high, column)).orderBy(F.asc_nulls_last(F.coalesce("price_primary", "price_secondary")), "entity_id").limit(limit)


def top_by_price(rows: DataFrame, n: int, dearest: bool = True) -> DataFrame:
    price = F.coalesce("price_primary", "price_secondary")
    return rows.where(price.isNotNull()).orderBy(price.desc() if dearest else price.asc(), "entity_id").limit(n)


def matches(keyword: str, synonyms: tuple[str, ...] = (), attributes: str | None = "attributes", least: int = 5) -> Column:
    """Name or category holds the keyword or a synonym, accents and number notation aside; longer words are looked for in attributes too."""
    out = F.lit(False)
    for word in dict.fromkeys([keyword.strip().lower(), *(s.strip().lower() for s in synonyms)]):
        if not word:
            continue
        w = fold(F.lit(word))
        out = out | F.contains(fold(F.col("name")), w) | F.contains(fold(F.col("category")), w) | F.contains(notation(F.col("name")), notation(F.lit(word)))
        if attributes and len(word) >= least:
            out = out | F.exists(F.map_values(attributes), lambda v: F.contains(fold(v), w))
    return F.coalesce(out, F.lit(False))


def by_keyword(rows: DataFrame, keyword: str, synonyms: tuple[str, ...] = (), limit: int = 1000) -> DataFrame:
    """Priced rows first, then by name."""
    priced = F.col("price_primary").isNotNull() | F.col("price_secondary").isNotNull()
    return rows.where(matches(keyword, synonyms)).orderBy(F.desc(priced), "name", "entity_id").limit(limit)


def reverse_keyword(rows: DataFrame, keyword: str, least: int = 6, floor: int = 3) -> DataFrame:
    """Rows whose name the keyword holds; short names only at its end."""
    k, name = fold(F.lit(keyword)), fold(F.col("name"))
    size = F.length("name")
    return rows.where(F.contains(k, name) & ((size >= least) | ((size >= floor) & F.endswith(k, name))))


def keyword_or_reverse(rows: DataFrame, keyword: str, synonyms: tuple[str, ...] = ()) -> DataFrame:
    """The reverse match only where the forward one finds nothing."""
    from lakeloom.operators.scope import with_fallback

    return with_fallback(rows.where(matches(keyword, synonyms)), reverse_keyword(rows, keyword))


def summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts, price bounds, price buckets and sorted categories."""
    price, bounds = F.col("price_primary"), [b for _, b in BUCKETS]
    buckets = [F.count_if((price < b) & (price >= a) if a is not None else price < b).alias(n) for (n, b), a in zip(BUCKETS, [None, *bounds], strict=False)]
    return rows.groupBy(*keys).agg(
        F.count("*").alias("entity_count"), F.min(price).alias("price_min"), F.max(price).alias("price_max"), *buckets, F.count_if(price >= bounds[-1]).alias("above_5M"), F.sort_array(F.collect_set("category")).alias("categories")
    )


def dedup_richest(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per name and first price, the richest, then the first; rows without a price go where the name has a priced one."""
    name = F.lower(F.trim("name")).alias("_name")
    rich = [F.col("price_secondary").isNotNull().cast("int"), F.size(F.coalesce("attributes", F.create_map().cast("map<string,string>"))), F.col("category").isNotNull().cast("int")]
    own = Window.partitionBy(*keys, "_name", "price_primary").orderBy(*[F.desc(r) for r in rich], "entity_id")
    best = rows.withColumn("_name", name).withColumn("_rn", F.row_number().over(own)).where("_rn = 1")
    priced = F.max(F.col("price_primary").isNotNull().cast("int")).over(Window.partitionBy(*keys, "_name"))
    return best.withColumn("_priced", priced).where("price_primary IS NOT NULL OR _priced = 0").drop("_rn", "_priced", "_name")


def dedup_newest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    own = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(at), F.desc(tie))
    return rows.withColumn("_rn", F.row_number().over(own)).where("_rn = 1").drop("_rn")


def duplicate_groups(rows: DataFrame, key: Column, item: str) -> DataFrame:
    """(content_hash, item, first_item, n): each row of a key that several rows share, with the first of them and their number. No group is gathered."""
    own = rows.select(key.alias("content_hash"), F.col(item).alias("item"))
    by = own.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("item").alias("first_item")).where("n > 1")
    return own.join(by, "content_hash").select("content_hash", "item", "first_item", "n")


def single_price_names(rows: DataFrame) -> DataFrame:
    """Names with exactly one distinct first price."""
    return rows.groupBy("name").agg(F.countDistinct("price_primary").alias("prices"), F.min("price_primary").alias("price")).where("prices = 1")


def reconcile(rows: DataFrame, alias: Column, least_digits: int = 5) -> DataFrame:
    """(entity_id, anchor_id): rows without a price joined to the first priced row that shares a digit key; anchors are taken in id order."""
    keyed = rows.select("entity_id", F.explode(F.array_distinct(F.regexp_extract_all(notation(alias), F.lit(rf"(\d{{{least_digits},}})"), 1))).alias("key"), (F.col("price_primary").isNotNull() | F.col("price_secondary").isNotNull()).alias("priced"))
    anchors = keyed.where("priced").groupBy("key").agg(F.min("entity_id").alias("anchor_id"))
    return keyed.where("NOT priced").join(anchors, "key").groupBy("entity_id").agg(F.min("anchor_id").alias("anchor_id"))


def with_chunk_ids(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Entities with the id of their chunk, null where there is none."""
    keys = chunks.select("doc_id", "chunk_index", F.col("chunk_id").alias("record_chunk_id"))
    return rows.join(keys, ["doc_id", "chunk_index"], "left")
