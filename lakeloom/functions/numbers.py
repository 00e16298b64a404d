"""Numbers and money in texts, and small arithmetic rules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unit suffixes of amounts.
UNITS = {"k": 1_000, "nghìn": 1_000, "ngàn": 1_000, "tr": 1_000_000, "triệu": 1_000_000, "m": 1_000_000, "tỷ": 1_000_000_000, "tỉ": 1_000_000_000, "đồng": 1}
NUMBER = r"\d[\d.,]*\d|\d"


def literal(token: Column, suffixed: bool) -> Column:
    """A number with . or , between digits. Both: the last one is the decimal point. Several of one: groups. One: the decimal point before a unit or unless three digits follow."""

    def read(t: Column) -> Column:
        dots, commas = F.regexp_count(t, F.lit(r"\.")), F.regexp_count(t, F.lit(","))
        bare = F.regexp_replace(t, "[.,]", "")
        point = F.concat(F.regexp_replace(F.regexp_extract(t, r"^(.*)[.,](\d+)$", 1), "[.,]", ""), F.lit("."), F.regexp_extract(t, r"^(.*)[.,](\d+)$", 2))
        one = F.lit(True) if suffixed else ~F.rlike(t, F.lit(r"[.,]\d{3}$"))
        text = F.when(dots + commas == 0, t).when((dots > 0) & (commas > 0), point).when(dots + commas > 1, bare).when(one, point).otherwise(bare)
        return text.try_cast("double")

    # Bound to a variable, so the token's own expression is evaluated once.
    return F.get(F.transform(F.array(token), read), F.lit(0))


def money(text: Column, least: int = 0, most: int | None = None) -> Column:
    """The first amount as a whole number: compound millions (1tr499), a number with a unit, or a bare number; null outside the bounds."""
    low = F.lower(F.trim(text))
    compound = r"(\d[\d.,]*\d|\d)\s*(?:tr|triệu)\s*(\d{1,3})?(?![\p{L}\d])"
    base, extra = F.regexp_extract(low, compound, 1), F.regexp_extract(low, compound, 2)
    first = F.round(literal(base, True) * 1_000_000 + F.coalesce(extra.try_cast("double"), F.lit(0.0)) * 1_000)
    names = "|".join(sorted(UNITS, key=len, reverse=True))
    unit = rf"({NUMBER})\s*({names})(?!\p{{L}})"
    table = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    second = F.round(literal(F.regexp_extract(low, unit, 1), True) * F.try_element_at(table, F.regexp_extract(low, unit, 2)))
    third = F.round(literal(F.regexp_extract(low, rf"(?<![\d.,\-])({NUMBER})", 1), False))
    value = F.when(base != "", first).when(F.regexp_extract(low, unit, 1) != "", second).otherwise(third).try_cast("long")
    ok = value >= least
    return F.when(ok & (value <= most) if most is not None else ok, value)


def significant(text: Column, digits: int = 4) -> Column:
    """Number tokens with so many digits or more, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({NUMBER})"), 1)
    return F.filter(found, lambda t: F.length(F.regexp_replace(t, "[^0-9]", "")) >= digits)


def dropped(source: Column, chunks: Column, digits: int = 4) -> Column:
    """Number tokens of the source that stand in none of the chunks, each once, in order."""
    return F.filter(F.array_distinct(significant(source, digits)), lambda t: ~F.exists(chunks, lambda c: F.contains(c, t)))


def ungrounded(answer: Column, sources: Column, digits: int = 1) -> Column:
    """Numbers of an answer, separators aside, that no source has."""
    bare = lambda x: F.transform(significant(x, digits), lambda t: F.regexp_replace(t, "[.,]", ""))
    return F.array_except(bare(answer), F.flatten(F.transform(sources, bare)))


def classify_numbers(answer: Column, sources: Column, digits: int = 4) -> Column:
    """(number, kind) for each number of an answer: grounded in a source, derived as a sum or difference of two source numbers, or unsupported."""
    to_long = lambda x: F.filter(F.transform(significant(x, digits), lambda t: F.regexp_replace(t, "[.,]", "").try_cast("long")), lambda v: v.isNotNull())
    known = F.array_distinct(F.flatten(F.transform(sources, to_long)))

    def kind(v: Column) -> Column:
        made = F.exists(known, lambda a: F.exists(known, lambda b: (a + b == v) | (a - b == v)))
        return F.struct(v.alias("number"), F.when(F.array_contains(known, v), "grounded").when(made, "derived").otherwise("unsupported").alias("kind"))

    return F.transform(F.array_distinct(to_long(answer)), kind)


def claims(text: Column) -> Column:
    """Typed numeric claims: percents, durations and document numbers."""
    kinds = {"percent": r"\d+(?:[.,]\d+)?\s*%", "duration": r"(?i)\d+\s*(?:days?|hours?|minutes?|months?|years?|ngày|giờ|phút|tháng|năm)", "docref": r"\d+/\d{4}/[A-ZĐ\-]+", "money": r"(?i)\d[\d.,]*\s*(?:k|tr|triệu|tỷ|đ|đồng|vnd|usd|\$|€)(?!\p{L})"}

    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("claim")))

    return F.concat(*[found(k, p) for k, p in kinds.items()])


def effective_limit(system: Column, extra: Column, default: int = 1_000_000) -> Column:
    return F.when(system >= 1, system).otherwise(default) + F.when(extra >= 0, extra).otherwise(0)


def just_depleted(before: Column, after: Column, limit: Column) -> Column:
    """Whether usage crossed its limit with this call."""
    return (before < limit) & (limit <= after)


def band(value: Column, edges: list[tuple[float, str]], last: str) -> Column:
    """The name of the first edge that the value doesn't exceed."""
    out = F.when(value.isNull(), None)
    for edge, name in edges:
        out = out.when(value <= edge, name)
    return out.otherwise(last)


def misattributed(answers: DataFrame, rows: DataFrame, digits: int = 4) -> DataFrame:
    """Numbers of an answer whose rows share no row with the answer's words: answers(answer_id, text), rows(answer_id, row_id, text)."""
    word = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: F.length(w) >= 4))
    inside = rows.select("answer_id", "row_id", F.explode(word(F.col("text"))).alias("word"))
    named = answers.select("answer_id", F.explode(word(F.col("text"))).alias("word")).join(inside, ["answer_id", "word"]).select("answer_id", "row_id").distinct()
    numbers = rows.select("answer_id", "row_id", F.explode(F.array_distinct(significant(F.col("text"), digits))).alias("number"))
    used = answers.select("answer_id", F.explode(F.array_distinct(significant(F.col("text"), digits))).alias("number"))
    homes = used.join(numbers, ["answer_id", "number"])
    good = homes.join(named, ["answer_id", "row_id"], "left_semi").select("answer_id", "number")
    return homes.select("answer_id", "number").distinct().join(good, ["answer_id", "number"], "left_anti")
