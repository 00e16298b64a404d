"""Shapes of texts and cells: how dense a text is, what a question is after, what a cell holds, which of a question's words tell candidates apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.numbers import money
from lakeloom.functions.text import quality_score

#: Share of different words and letters of a sentence that count as fully complex; sizes of chunks of complex and of simple texts.
DENSE, LONG, SMALL, LARGE = 0.8, 200.0, 300, 1000
#: Forms of questions, in order, and how sure a form at the start and one within the text is.
INTENTS = (
    ("greeting", r"^(xin chào|hi|hello|chào em|chào bạn|chào shop|hey|xin chao)\b"),
    ("chitchat", r"^(cảm ơn|cám ơn|thanks|thank you|ok\b|được rồi|tốt lắm|hay lắm|tuyệt|tuyệt vời|đúng rồi|vâng|dạ|oke|okay)\b"),
    ("aggregation", r"(có mấy|bao nhiêu|liệt kê|tất cả|toàn bộ|kể tên|các loại|mấy loại|bao gồm những gì|gồm những gì)"),
    ("multi_hop", r"(tại sao|vì sao|giải thích|nguyên nhân|lý do|how come|why)"),
    ("comparison", r"(so sánh|khác nhau|khác gì|vs\b|versus|difference between|hơn hay kém|tốt hơn|nên chọn)"),
)
AT_START, WITHIN = 0.90, 0.80
#: Separators from which on a cell is a list; letters of a triple's ends and of its relation; letters behind a denial in which a name is looked for; the score of a chunk that passes.
SEPARATORS, ENDS, RELATION, BEHIND, PASSING = 3, 500, 200, 48, 0.5
WORD2, WORD3 = r"(\p{L}{2,})", r"(\p{L}{3,})"
NAME = r"(\p{Lu}[\p{L}0-9]{2,})"


def _strip(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def _let(value: Column, then) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


# ---- texts ----


def complexity(text: Column) -> Column:
    """Mean of the share of different words and of the length of sentences, each up to what counts as fully complex; 0 for blank texts."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    parts = F.filter(F.transform(F.split(text, r"[.!?](?:\s+|\z)", -1), _strip), lambda s: s != "")
    density = _let(words, lambda w: F.coalesce(F.try_divide(F.size(F.array_distinct(w)), F.size(w)), F.lit(0.0)))
    length = _let(parts, lambda p: F.coalesce(F.try_divide(F.aggregate(p, F.lit(0), lambda a, s: a + F.length(s)), F.size(p)), F.lit(0.0)))
    both = (F.least(density / DENSE, F.lit(1.0)) + F.least(length / LONG, F.lit(1.0))) / 2
    return F.when(_strip(text) == "", 0.0).otherwise(both)


def adaptive_size(score: Column, small: int = SMALL, large: int = LARGE) -> Column:
    """Letters of a chunk: large for simple texts, small for complex ones."""
    kept = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return F.bround(large - kept * (large - small)).cast("int")


def heuristic_intent(question: Column) -> Column:
    """(intent, confidence) by the first form that a question has; null for other and blank ones."""
    text = _strip(question)
    sure = lambda pattern: F.lit(AT_START if pattern.startswith("^") else WITHIN)
    return F.coalesce(*[F.when((text != "") & F.rlike(text, F.lit(f"(?iU){p}")), F.struct(F.lit(name).alias("intent"), sure(p).alias("confidence"))) for name, p in INTENTS])


def asks_for_all(question: Column, keywords: list[str]) -> Column:
    """Whether a question holds one of the words by which all or their number are asked for."""
    low = F.lower(F.coalesce(question, F.lit("")))
    return F.exists(F.array(*[F.lit(k.lower()) for k in keywords if k]).cast("array<string>"), lambda k: F.contains(low, k))


def quality_gate(chunks: DataFrame, text: str = "content", least: float = PASSING) -> DataFrame:
    """chunks with their quality score and whether they pass it."""
    return chunks.withColumn("quality", F.round(quality_score(F.col(text)), 9)).withColumn("passed", F.col("quality") >= least)


# ---- cells ----


def cell_shape(cell: Column) -> Column:
    """empty, url, list, money, number, code, name or token, by shape alone."""

    def shape(s: Column) -> Column:
        count = lambda c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
        n_words = F.size(F.regexp_extract_all(s, F.lit(WORD2), 1))
        digits = F.length(F.regexp_replace(s, r"[^0-9]", ""))
        units = F.regexp_replace(F.lower(s), r"(?U)(?<!\p{L})(vnđ|vnd|usd|triệu|nghìn|ngàn|đồng|tỷ|tr|đ|k)(?!\p{L})", " ")
        bare = F.regexp_replace(F.regexp_replace(units, r"(?<=\d)(tr)(?=\d)", " "), r"[\d.,\s/]", "")
        return (
            F.when(s == "", "empty").when(F.rlike(s, F.lit("^https?://")), "url").when((count(",") >= SEPARATORS) | (count(";") >= SEPARATORS), "list")
            .when((digits > 0) & money(s).isNotNull() & ~F.rlike(bare, F.lit(r"\p{L}")) & ~F.rlike(s, F.lit(r"\d[/\-]\d")), "money").when(F.rlike(s, F.lit(r"^[\d.,\s]+$")) & (digits > 0), "number")
            .when((n_words <= 1) & (F.rlike(s, F.lit(r"\d+[/\-]\d+")) | (digits >= 2)), "code").when(n_words >= 2, "name").otherwise("token")
        )

    return _let(_strip(cell), shape)


def descriptive_name(cells: Column) -> Column:
    """The fullest name among cells: names by their words and letters, a code only where there is no name; the first of equals, null if there is neither."""
    bare = F.transform(cells, _strip)
    score = lambda s: _let(cell_shape(s), lambda k: F.when(k == "name", 1000 + F.size(F.regexp_extract_all(s, F.lit(WORD2), 1)) * 10 + F.length(s)).when(k == "code", 1).otherwise(0))
    rated = F.transform(bare, lambda s, i: F.struct(score(s).alias("score"), (-i).alias("at"), s.alias("name")))
    return _let(F.array_max(rated), lambda r: F.when(r["score"] > 0, r["name"]))


def discriminated(candidates: DataFrame) -> DataFrame:
    """candidates(query_id, query, candidate_id, text) narrowed by the words of the query, in order, that some of those left hold and others don't.

    What a candidate holds is a word of noughts and ones, one for each of the query's words; only the different ones of a query are gathered and narrowed.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("query", F.lit(""))), F.lit(WORD3), 1))
    low = F.lower(F.coalesce("text", F.lit("")))
    marked = candidates.withColumn("_mask", F.array_join(F.transform(words, lambda w: F.contains(low, w).cast("int").cast("string")), ""))
    masks = marked.groupBy("query_id").agg(F.collect_set("_mask").alias("masks"))

    def narrow(left: Column, k: Column) -> Column:
        return _let(F.filter(left, lambda m: F.substring(m, k, F.lit(1)) == "1"), lambda have: F.when((F.size(have) > 0) & (F.size(have) < F.size(left)), have).otherwise(left))

    size = F.length(F.element_at("masks", 1))
    steps = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    kept = masks.select("query_id", F.explode(F.aggregate(steps, F.col("masks"), narrow)).alias("_mask"))
    return marked.join(kept, ["query_id", "_mask"], "left_semi").drop("_mask")


# ---- answers ----


def triples(answer: Column) -> Column:
    """(subject, relation, object) of a JSON list in an answer, fenced or not: cut to length, without empty ones and those whose ends are the same."""
    bare = F.array_join(F.filter(F.split(_strip(answer), "\n", -1), lambda line: ~F.startswith(F.ltrim(line), F.lit("```"))), "\n")
    body = F.regexp_extract(F.when(F.startswith(_strip(answer), F.lit("```")), bare).otherwise(_strip(answer)), r"(?s)(\[.*\])", 1)
    found = F.from_json(body, "array<struct<subject:string,relation:string,object:string>>")
    cut = F.transform(found, lambda t: F.struct(*[F.substring(_strip(t[c]), 1, n).alias(c) for c, n in (("subject", ENDS), ("relation", RELATION), ("object", ENDS))]))
    good = F.filter(cut, lambda t: (t["subject"] != "") & (t["relation"] != "") & (t["object"] != "") & (F.lower(t["subject"]) != F.lower(t["object"])))
    return F.coalesce(good, F.array().cast("array<struct<subject:string,relation:string,object:string>>"))


def denied_brand(answer: Column, question: Column, phrases: list[str]) -> Column:
    """The name that an answer denies to sell: the first capitalised word close behind the first phrase that stands in it, one of the question's before others."""
    low, asked = F.lower(F.coalesce(answer, F.lit(""))), F.lower(F.coalesce(question, F.lit("")))

    def behind(phrase: str) -> Column:
        at = F.instr(low, F.lit(phrase.strip().lower()))
        names = F.regexp_extract_all(F.substring(answer, at + len(phrase.strip()), F.lit(BEHIND)), F.lit(NAME), 1)
        return F.when(at > 0, _let(names, lambda n: F.coalesce(F.get(F.filter(n, lambda x: (asked != "") & F.contains(asked, F.lower(x))), F.lit(0)), F.get(n, F.lit(0)))))

    return F.coalesce(*[behind(p) for p in phrases if p.strip()], F.lit(None).cast("string"))
