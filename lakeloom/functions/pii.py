"""Personal data and secrets in texts, found and replaced by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds and their patterns, in order of rank where two finds are the same span. Word letters and digits are of any script.
PATTERNS = (
    ("DSN", r"\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp):\/\/[^\s:@]+:[^\s@]+@[^\s\/]+"),
    ("JWT", r"\beyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\b"),
    ("API_KEY", r"\b(?:sk-[A-Za-z0-9_\-]{20,}|AIza[0-9A-Za-z\-_]{20,}|xox[abprs]-[0-9A-Za-z\-]{10,})\b"),
    ("API_KEY", r"\b(?:sk|pk|rk|tok|key|api|bearer)[_\-]?[A-Za-z0-9]{16,}\b"),
    ("CCCD", r"\b\d{12}\b"),
    ("CCCD", r"\b\d{4}\s\d{4}\s\d{4}\b"),
    ("CARD", r"\b(?:\d[ \-]?){13,19}\b"),
    ("VN_PLATE", r"\b\d{2}[\s\-]?[A-Z]{1,2}\d?[\s\-]?\d{3,5}(?:\.\d{2})?\b"),
    ("PHONE", r"\b0\d{9,10}\b"),
    ("PHONE", r"\b0\d{2,3}[\s.\-]\d{3,4}[\s.\-]\d{3,4}\b"),
    ("EMAIL", r"[\w.+-]+@[\w-]+\.[\w.-]+"),
)
#: What a text must hold before a kind's patterns are tried.
NEEDS = {"DSN": "://", "JWT": "eyJ", "EMAIL": "@"}
DIGITS = ("CCCD", "CARD", "PHONE")


def _matches(text: Column, pattern: str, kind: str, rank: int) -> Column:
    """(start, size, rank, kind) of a pattern's finds: places follow from the lengths of what lies between them."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    sizes = F.transform(F.arrays_zip(between.alias("b"), found.alias("f")), lambda x: F.struct(F.length(x["b"]).alias("skip"), F.coalesce(F.length(x["f"]), F.lit(0)).alias("size")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,size:int,rank:int,kind:string>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["skip"]
        one = F.struct(start.alias("start"), x["size"].alias("size"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"))
        return F.struct((start + x["size"]).alias("at"), F.when(x["size"] > 0, F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(sizes, zero, add, lambda acc: acc["out"])


def spans(text: Column) -> Column:
    """(start, size, kind) of what is redacted: of the finds of all patterns on the text itself, from left to right, at each place the longest that begins there and not within an earlier one."""
    nothing = F.array().cast("array<struct<start:int,size:int,rank:int,kind:string>>")
    digits = F.rlike(text, F.lit(r"\d{3}"))
    every = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        unicode = f"(?U){pattern}"
        guard = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else digits if kind in DIGITS else F.lit(True)
        every.append(F.when(guard & F.rlike(text, F.lit(unicode)), _matches(text, unicode, kind, rank)).otherwise(nothing))
    ordered = F.array_sort(F.transform(F.flatten(F.array(*every)), lambda x: F.struct(x["start"].alias("start"), (-x["size"]).alias("less"), x["rank"].alias("rank"), x["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,size:int,kind:string>>").alias("out"))

    def keep(acc: Column, x: Column) -> Column:
        free = x["start"] >= acc["end"]
        one = F.struct(x["start"].alias("start"), (-x["less"]).alias("size"), x["kind"].alias("kind"))
        return F.struct(F.when(free, x["start"] - x["less"]).otherwise(acc["end"]).alias("end"), F.when(free, F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(ordered, zero, keep, lambda acc: acc["out"])


def redact(text: Column, found: Column | None = None) -> Column:
    """The text with each of its spans replaced by the kind in brackets; null stays null."""

    def build(found: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def add(acc: Column, x: Column) -> Column:
            plain = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
            return F.struct((x["start"] + x["size"]).alias("at"), F.concat(acc["out"], plain, F.lit("["), x["kind"], F.lit("]")).alias("out"))

        return F.aggregate(found, zero, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text) - acc["at"])))

    # Bound to a variable, so the spans are found once.
    all_of = F.get(F.transform(F.array(spans(text) if found is None else found), lambda s: F.when(F.size(s) > 0, build(s)).otherwise(text)), F.lit(0))
    return F.when(text.isNotNull(), all_of)


def count(text: Column) -> Column:
    """How many spans would be redacted."""
    return F.when(text.isNotNull(), F.size(spans(text)))
