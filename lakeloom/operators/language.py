"""Vocabulary in questions, texts cut down to what tells most, and superlatives answered from free text."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.text import BLANK, bound

#: Tokens of a phrase at most; tokens before a phrase that may deny it; phrases of a question and expansions of a phrase at most.
WORDS, BACK, MATCHES, EXPANSIONS = 3, 2, 10, 5
#: Fixed value: what is taken off a token's ends.
MARKS = ".,!?;:'\"()[]{}/\\"
#: Letters that a text is cut down to, and the score of a sentence that stays.
LETTERS, TELLING = 500, 0.15
#: Signs and words of money.
MONEY = ("$", "€", "₫", "vnd", "usd", "triệu", "tỷ", "nghìn")
#: Best items of a superlative.
TOP = 5
#: The words that ask for a superlative, by what they ask for, in order.
ASKED = {
    "max_price": ("cao nhất", "đắt nhất", "cao cấp nhất", "premium nhất", "vip nhất", "luxury nhất", "sang nhất", "xịn nhất", r"\bmost expensive\b", r"\bhighest price\b", r"\bhighest[- ]priced\b", r"\bpremium(?:[- ]tier)?\b", r"\btop[- ]tier\b", r"\bluxury\b", r"\bvip\b"),
    "min_price": ("rẻ nhất", "thấp nhất", "phải chăng nhất", "giá tốt nhất", "giá dễ chịu nhất", "economic nhất", r"\bcheapest\b", r"\blowest price\b", r"\blowest[- ]priced\b", r"\bmost affordable\b", r"\bbest price\b", r"\beconomic(?:al)?\b"),
    "longest_duration": ("lâu nhất", "dài nhất", "thời gian dài nhất", r"\blongest\b", r"\bmost time\b", r"\bgreatest duration\b"),
    "shortest_duration": ("nhanh nhất", "ngắn nhất", "thời gian ít nhất", r"\bshortest\b", r"\bquickest\b", r"\bfastest\b", r"\bleast time\b"),
    "max_discount": ("giảm giá nhiều nhất", "giảm nhiều nhất", "khuyến mãi nhất", "sale nhiều nhất", "ưu đãi nhất", r"\bbiggest discount\b", r"\bhighest discount\b", r"\bbest deal\b", r"\bbiggest sale\b", r"\bmost off\b"),
    "min_discount": ("giảm ít nhất", r"\bsmallest discount\b", r"\blowest discount\b"),
    "max_bonus": ("tặng nhiều nhất", "nhiều quà nhất", "bonus cao nhất", r"\bmost bonus(?:es)?\b", r"\bmost gifts?\b", r"\bhighest bonus\b"),
}
#: A discount, a bonus, a name with its price, a name with its duration.
DISCOUNT = r"(?i:giảm|sale|ưu đãi|discount)\s*\d+\s*%"
BONUS = r"(?i:tặng|bonus)\s+\d+\s*(?:buổi|lần|quà|voucher)?"
PRICE = r"[^:\n,]{4,80}?:\s*\d{1,3}(?:[.,]\d{3})+\s*(?:đ|đồng|VND)?"
DURATION = r"[^:\n,]{4,60}?\s+\d+\s*(?:phút|giờ|buổi)"


# ---- vocabulary ----


def phrases(texts: DataFrame, key: str, longest: int = WORDS) -> DataFrame:
    """(key, at, n, phrase, before): every run of 1 to longest tokens of a text, with the tokens just before it."""
    trim = lambda t: F.regexp_replace(t, rf"^[{_class(MARKS)}]+|[{_class(MARKS)}]+$", "")
    bare = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"^\s+|\s+$", "")
    rows = texts.select(key, F.transform(F.when(bare != "", F.split(bare, r"\s+")).otherwise(F.array().cast("array<string>")), trim).alias("t"))
    at = rows.where(F.size("t") > 0).select(key, "t", F.explode(F.sequence(F.lit(0), F.size("t") - 1)).alias("at"), F.lit(None).alias("_"))
    runs = at.select(key, "t", "at", F.explode(F.array(*[F.lit(n) for n in range(1, longest + 1)])).alias("n")).where(F.col("at") + F.col("n") <= F.size("t"))
    words = F.slice("t", F.col("at") + 1, F.col("n"))
    before = F.slice("t", F.greatest(F.col("at") - BACK, F.lit(0)) + 1, F.least(F.col("at"), F.lit(BACK)))
    return runs.select(key, "at", "n", words.alias("w"), before.alias("before")).where(~F.array_contains("w", "")).select(key, "at", "n", F.array_join("w", " ").alias("phrase"), "before")


def _class(marks: str) -> str:
    return "".join(f"\\{c}" for c in marks)


def vocabulary_matches(texts: DataFrame, vocabulary: DataFrame, negations: list[str], key: str = "query_id", most: int = MATCHES, expansions: int = EXPANSIONS) -> DataFrame:
    """(key, place, at, n, phrase, source, expansions): the phrases of vocabulary(phrase, source, expansions) in texts(key, text), single tokens first.

    A phrase counts once, where it first stands undenied; one of several tokens behind a negation doesn't. Of two entries for a phrase the one of the bot
    holds. Phrases meet by equality, so a vocabulary of any size is one join.
    """
    own = Window.partitionBy("phrase").orderBy(F.when(F.col("source") == "bot_custom", 0).otherwise(1), "source")
    known = vocabulary.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")
    met = phrases(texts, key).join(known, "phrase")
    denied = F.arrays_overlap("before", F.array(*[F.lit(w) for w in negations])) if negations else F.lit(False)
    met = met.where((F.col("n") == 1) | ~F.coalesce(denied, F.lit(False)))
    first = met.groupBy(key, "phrase").agg(F.min("at").alias("at"), F.first("n").alias("n"), F.first("source").alias("source"), F.first("expansions").alias("expansions"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("n", "at", "phrase"))
    return first.withColumn("place", place).where(F.col("place") <= most).select(key, "place", "at", "n", "phrase", "source", F.slice("expansions", 1, expansions).alias("expansions"))


def vocabulary_variants(texts: DataFrame, matches: DataFrame, key: str = "query_id", most: int = EXPANSIONS) -> DataFrame:
    """(key, place, variant): a text as it is, then with one phrase after the other replaced by its expansions where it stands as whole words."""
    flat = matches.select(key, "place", "phrase", F.posexplode("expansions").alias("k", "expansion"))
    low = F.lower("text")
    quoted = F.regexp_replace("phrase", r"([^\p{L}\p{N}\s])", "\\\\$1")
    new = F.regexp_replace(low, F.concat(F.lit(r"(?U)\b"), quoted, F.lit(r"\b")), F.regexp_replace("expansion", r"([\\$])", "\\\\$1"))
    made = flat.join(texts.select(key, "text"), key).withColumn("variant", new).where("variant <> lower(text) AND variant <> text")
    once = made.groupBy(key, "variant").agg(F.min(F.struct("place", "k")).alias("at"))
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("at"))).where(F.col("place") <= most).select(key, "place", "variant")
    return texts.select(key, F.lit(0).alias("place"), F.col("text").alias("variant")).where("variant <> ''").unionByName(ranked)


# ---- compression ----


def _without(text: Column, pattern: str, new: str, *needs: str) -> Column:
    """text with a pattern replaced; only a text that holds one of needs can match."""
    return bound(text, lambda t: F.when(_holds(t, needs), F.regexp_replace(t, pattern, new)).otherwise(t))


def _holds(text: Column, needs: Iterable[str]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(n)) for n in needs))


def plain(text: Column, boilerplate: list[str] = ()) -> Column:
    """A text without boilerplate, marks of markdown, links and needless white space."""

    def tidy(t: Column) -> Column:
        t = _without(_without(t, r"[ \t]+\n", "\n", " \n", "\t\n"), r"[ \t]{2,}", " ", "  ", " \t", "\t ", "\t\t")
        return F.btrim(_without(t, r"\n{3,}", "\n\n", "\n\n\n"), F.lit(BLANK))

    out = tidy(F.coalesce(text, F.lit("")))
    for p in boilerplate:
        out = F.regexp_replace(out, p, "")
    out = tidy(out) if boilerplate else out
    out = _without(out, r"\[([^\]]*)\]\([^\)]*\)", "$1", "](")
    for mark in ("~~", "*", "_"):
        out = F.replace(out, F.lit(mark), F.lit(""))
    return tidy(_without(out, r"(?m)^#{1,6}\s+", "", "#"))


def telling(sentence: Column, stopwords: list[str], negations: list[str]) -> Column:
    """Share of a sentence's words that say something, more for numbers, money, dates, shares and negations; 1 at most."""
    stop = F.array(*[F.lit(w) for w in stopwords if w not in negations]).cast("array<string>")
    no = F.array(*[F.lit(w) for w in negations]).cast("array<string>")
    has = lambda p, gain: F.when(F.rlike(sentence, F.lit(p)), gain).otherwise(0.0)
    # Dates and shares are looked for only where a digit stands.
    number = F.when(F.rlike(sentence, F.lit(r"\d")), 0.1 + has(r"\d{1,2}[/.\-]\d{1,2}|\d{4}", 0.1) + has(r"\d+\s*%", 0.1)).otherwise(0.0)
    low = F.lower(sentence)
    gain = number + F.when(_holds(low, MONEY), has(rf"(?i)[$€₫]|\b(?:{'|'.join(MONEY[3:])})\b", 0.15)).otherwise(0.0)

    def score(words: Column) -> Column:
        base = F.size(F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))) / F.size(words)
        denied = F.when(F.coalesce(F.arrays_overlap(words, no), F.lit(False)), 0.2).otherwise(0.0)
        return F.when(F.size(words) == 0, 0.0).otherwise(F.least(F.lit(1.0), base + gain + denied))

    return bound(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]+)"), 1), score)


def _chosen(scored: Column, least: float) -> Column:
    """The sentences that stay, in their order, of scored: (score, i, s) each."""
    told = lambda rows: F.transform(rows, lambda x: x["s"])
    best = F.array_sort(F.transform(scored, lambda x: F.struct((-x["score"]).alias("down"), x["i"].alias("i"), x["s"].alias("s"))))
    half = F.slice(best, 1, F.greatest(F.lit(1), F.floor(F.size(scored) / 2).cast("int")))
    half = F.array_sort(F.transform(half, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"))))
    good = bound(F.filter(scored, lambda x: x["score"] >= least), lambda g: F.when(F.size(g) > 0, told(g)).otherwise(told(half)))
    return F.when(F.size(scored) == 1, told(scored)).otherwise(good)


def _cut(kept: Column, most: int) -> Column:
    """As many sentences as fit into so many letters, to the last end of one; if the first doesn't, its first letters."""
    # Each has a letter and a blank, so those behind these can't fit. One without a mark at its end runs into the next one.
    some, n = F.slice(kept, 1, most // 2 + 2), F.size(kept)

    def step(a: Column, s: Column) -> Column:
        at = a["at"] + F.when(a["i"] > 0, 1).otherwise(0) + F.length(s)
        fits = (at <= most) & (F.rlike(s, F.lit(r"[.!?;]$")) | (a["i"] + 1 == n))
        return F.struct(at.alias("at"), (a["i"] + 1).alias("i"), F.when(fits, at).otherwise(a["end"]).alias("end"))

    zero = F.lit(0)
    end = F.aggregate(some, F.struct(zero.alias("at"), zero.alias("i"), zero.alias("end")), step, lambda a: F.when(a["end"] > 0, a["end"]).otherwise(most))
    return F.substring(F.array_join(some, " "), F.lit(1), end)


def compressed(texts: DataFrame, key: str, stopwords: list[str], negations: list[str], most: int = LETTERS, least: float = TELLING, boilerplate: list[str] = ()) -> DataFrame:
    """(key, text): texts(key, text) in so many letters at most: in a longer one the sentences that tell something, in their order, as many as fit.

    If none tells enough, the better half does. What is put together is cut at the ends of its sentences; a first sentence that is too long is cut itself.
    A text is cut where it is read: nothing is shuffled. Long ones without any sentence give no row.
    """
    bare = texts.select(key, plain(F.col("text"), list(boilerplate)).alias("text"))
    parts = F.filter(F.transform(F.split(F.regexp_replace("text", r"([.!?;])\s+|\n+", "$1\u0001"), "\u0001"), lambda s: F.btrim(s, F.lit(BLANK))), lambda s: s != "")
    scored = F.transform(parts, lambda s, i: F.struct(F.round(telling(s, stopwords, negations), 9).alias("score"), i.alias("i"), s.alias("s")))
    none = F.array().cast("array<string>")
    long = bound(scored, lambda p: F.when(F.size(p) > 0, F.array(bound(_chosen(p, least), lambda k: _cut(k, most)))).otherwise(none))
    # An array that is written out, and no filter: a filter would work the text out a second time.
    return bare.select(key, F.explode(F.when(F.length("text") <= most, F.array("text")).otherwise(long)).alias("text"))


# ---- superlatives ----


def intent(question: Column) -> Column:
    """What a superlative asks for; null if there is none."""
    low = F.lower(question)
    return F.coalesce(*[F.when(F.rlike(low, F.lit("|".join(f"(?:{p})" for p in ps))), F.lit(name)) for name, ps in ASKED.items()])


def spans(chunks: DataFrame) -> DataFrame:
    """(grp, chunk, at, kind, name, value) of chunks(grp, chunk, text): prices and durations with their names, discounts and bonuses, in order.

    One scan of the text finds all of them in the order in which they stand.
    """
    found = F.regexp_extract_all("text", F.lit(f"({DISCOUNT}|{BONUS}|{PRICE}|{DURATION})"), 1)
    flat = chunks.select("grp", "chunk", F.posexplode(found).alias("at", "span"))
    kind = F.when(F.rlike("span", F.lit(DISCOUNT + r"\s*$")), "discount").when(F.rlike("span", F.lit(BONUS + r"\s*$")), "bonus").when(F.contains("span", F.lit(":")), "price").otherwise("duration")
    value = F.when(F.col("kind") == "price", F.regexp_replace(F.regexp_extract("span", r":\s*([\d.,]+)", 1), "[.,]", "")).otherwise(F.regexp_extract("span", r"(\d+)[^\d]*$", 1))
    name = F.when(F.col("kind") == "price", F.regexp_extract("span", r"(?s)^(.*?):\s*\d", 1)).when(F.col("kind") == "duration", F.regexp_extract("span", r"(?s)^(.*?)\s+\d+\s*\S+$", 1))
    out = flat.withColumn("kind", kind).select("grp", "chunk", "at", "kind", F.regexp_replace(name, r"^\s+|\s+$", "").alias("name"), value.cast("long").alias("value"))
    return out.where("kind <> 'price' OR name <> ''")


def ranked_items(chunks: DataFrame) -> DataFrame:
    """(grp, name, place, price, duration, discount, bonus): the priced items of a group's chunks, by their first place.

    An item has its highest price. A duration belongs to the item of its name, else to the nearest item before it, as discounts and bonuses do; the first of
    each counts.
    """
    found = spans(chunks)
    priced = found.where("kind = 'price'").select("grp", "name").distinct().withColumn("item", F.col("name"))
    both = found.join(priced, ["grp", "name"], "left")
    own = Window.partitionBy("grp").orderBy("chunk", "at")
    near = F.last(F.when(F.col("kind") == "price", F.col("name")), ignorenulls=True).over(own)
    both = both.withColumn("of", F.coalesce("item", near)).where("of IS NOT NULL")
    at = F.struct("chunk", "at")
    first = lambda kind: F.min_by(F.when(F.col("kind") == kind, F.col("value")), F.when(F.col("kind") == kind, at)).alias(kind)
    items = both.groupBy("grp", F.col("of").alias("name")).agg(
        F.min(F.when(F.col("kind") == "price", at)).alias("_at"), F.max(F.when(F.col("kind") == "price", F.col("value"))).alias("price"), first("duration"), first("discount"), first("bonus")
    )
    place = F.row_number().over(Window.partitionBy("grp").orderBy("_at"))
    return items.withColumn("place", place).drop("_at")


def superlatives(questions: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, intent, rank, name, value): the k items of the question's group at the end that it asks for; equal ones by their place.

    questions: (query_id, grp, text). Items without the value asked for aren't ranked.
    """
    asked = questions.withColumn("intent", intent(F.col("text"))).where("intent IS NOT NULL")
    value = F.when(F.endswith("intent", F.lit("price")), F.col("price")).when(F.endswith("intent", F.lit("duration")), F.col("duration")).when(F.endswith("intent", F.lit("discount")), F.col("discount")).otherwise(F.col("bonus"))
    rows = asked.select("query_id", "grp", "intent").join(items, "grp").withColumn("value", value).where("value IS NOT NULL")
    up = F.col("intent").isin("min_price", "shortest_duration", "min_discount")
    own = Window.partitionBy("query_id").orderBy(F.when(up, F.col("value")).otherwise(-F.col("value")), "place")
    return rows.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "intent", "rank", "name", "value")
