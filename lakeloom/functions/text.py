"""Scalar text functions as column expressions."""

from __future__ import annotations

import hashlib
import re
import unicodedata
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions import pii
from lakeloom.operators.structured import COMBINING, MARKED, PLAIN


#: White space as \\s has it.
BLANK = " \t\n\v\f\r"


def _mapped(column: Column, f: Callable[[str], str]) -> Column:
    """An Arrow-batched string function; nulls stay. Made when called, as types need a session."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(f, na_action="ignore")

    return F.pandas_udf(run, "string")(column)


def nfc(text: Column) -> Column:
    """Canonical composition: the JVM has no expression for it."""
    return _mapped(text, lambda t: unicodedata.normalize("NFC", t))


def uuid5(name: Column) -> Column:
    """Name-based UUID in the URL namespace."""
    return _mapped(name, lambda n: str(uuid.uuid5(uuid.NAMESPACE_URL, n)))


def strip_marks(text: Column) -> Column:
    """Without accents, case kept, for letters of any Latin alphabet, composed or decomposed; đ stays, as it doesn't decompose."""
    pairs = [(c, p) for m, q in zip(MARKED[1:], PLAIN[1:], strict=True) for c, p in ((m, q), (m.upper(), q.upper())) if len(c) == 1]
    return F.translate(text, "".join(c for c, _ in pairs) + COMBINING, "".join(p for _, p in pairs))


def content_hash(text: Column) -> Column:
    """SHA-256 of the trimmed text with white space made one and in lower case."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))).cast("binary"), 256)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\r\n]+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where either is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_union(a, b)))), F.lit(0.0))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once a row, however often f names it and within whatever lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Distinct runs of n letters; none for shorter texts."""
    def runs(letters: Column) -> Column:
        firsts = F.slice(letters, 1, F.greatest(F.size(letters) - n + 1, F.lit(1)))
        return F.array_distinct(F.transform(firsts, lambda x, i: F.concat(x, *(F.get(letters, i + k) for k in range(1, n)))))

    # Bound to variables: a text that is an expression is worked out once and not once a run, and a run isn't counted off from the start of its text.
    return bound(text, lambda t: F.when(F.length(t) >= n, bound(F.split(t, ""), runs)).otherwise(F.array().cast("array<string>")))


def shingles(text: Column, n: int) -> Column:
    """Distinct runs of n words; none for shorter texts."""
    def runs(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.concat_ws(" ", *(F.get(w, i + (k - 1)) for k in range(n))))
        return F.when(F.size(w) >= n, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    # Bound to a variable, so the text is split once and not once a run.
    return F.get(F.transform(F.array(words(text)), runs), F.lit(0))


def shingle_overlap(draft: Column, main: Column, n: int) -> Column:
    """Share of the draft's shingles that main has; an empty draft is fully covered."""
    return shingles_held(draft, shingles(main, n), n)


def shingles_held(draft: Column, held: Column, n: int) -> Column:
    """shingle_overlap with the main text's shingles, which many drafts may share."""
    share = lambda a: F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, held)) / F.size(a))
    return bound(shingles(draft, n), share)


def leaks(answer: Column, known: list[str], n: int, least: int) -> Column:
    """Whether so many n-word runs of an answer are among the known ones."""
    return F.size(F.array_intersect(shingles(answer, n), F.array(*[F.lit(k) for k in known]) if known else F.array().cast("array<string>"))) >= least


def clean_line_breaks(text: Column) -> Column:
    """Words broken at line ends joined, blank lines at most one in a row, blanks and tabs made one, ends trimmed."""
    out = F.regexp_replace(text, r"([A-Za-zÀ-ÿ])-\n([A-Za-zÀ-ÿ])", "$1$2")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"^\s+|\s+$", "")


def drop_repeated_lines(text: Column, times: int = 3, shorter: int = 100, more_than: int = 10) -> Column:
    """Without the lines that stand in a long text several times and are short: running heads and feet."""

    def clean(lines: Column) -> Column:
        bare = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: (x != "") & (F.length(x) < shorter))
        # In the sorted lines, one that stands as often has its like so many places before it.
        often = bound(F.array_sort(bare), lambda o: F.array_distinct(F.filter(o, lambda x, i: (i >= times - 1) & (F.get(o, i - (times - 1)) == x))))
        kept = bound(often, lambda o: F.filter(lines, lambda x: ~F.array_contains(o, F.trim(x))))
        return F.when(F.size(lines) > more_than, F.array_join(kept, "\n")).otherwise(text)

    return bound(F.split(text, "\n", -1), clean)


#: Phrases that try to override instructions.
INJECTIONS = r"(?i)ignore (all |the )?(previous|above|prior) instructions|disregard (all |the )?(previous|above|prior) instructions|you are now (in )?developer mode|reveal (your|the) system prompt"


def redact_injections(text: Column, token: str = "[REDACTED]") -> Column:
    return F.regexp_replace(text, INJECTIONS, token.replace("$", r"\$"))


def clean_document(text: Column) -> Column:
    return clean_line_breaks(drop_repeated_lines(redact_injections(text)))


def embedding_text(text: Column) -> Column:
    """Without URLs and with white space made one; the text itself where nothing is left."""
    out = F.trim(F.regexp_replace(F.regexp_replace(text, r"https?://\S+", " "), r"\s+", " "))
    return F.when(out == "", text).otherwise(out)


def strip_fillers(text: Column, fillers: list[str]) -> Column:
    """Without whole filler words."""
    alternatives = "|".join(sorted((f.lower() for f in fillers), key=len, reverse=True))
    return F.trim(F.regexp_replace(F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{alternatives})(?![\p{{L}}\p{{N}}])", " "), r"\s+", " "))


def expand_abbreviations(text: Column, table: dict[str, str]) -> Column:
    """Whole words replaced by their long form; longer keys first."""
    for k in sorted(table, key=len, reverse=True):
        text = F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}]){k}(?![\p{{L}}\p{{N}}])", table[k])
    return text


def redact_pii(text: Column) -> Column:
    """Each find replaced by its kind in brackets; see lakeloom.functions.pii."""
    return pii.redact(text)


def pii_count(text: Column) -> Column:
    return pii.count(text)


def quality_score(text: Column, confidence: Column | None = None) -> Column:
    """0.3 for length, 0.2 for language, 0.2 for distinct words, 0.3 for no debris; 0 for blank texts.

    confidence is a language detector's, from 0 to 1; without a detector the language part is neutral, that is full.
    """
    n = F.length(text)
    length = F.when((n < 50) | (n > 4000), 0.0).when(n <= 800, (n - 50) / 750.0).otherwise((4000 - n) / 3200.0)

    def distinct(w: Column) -> Column:
        ratio = F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1))
        return F.when(F.size(w) < 2, 0.0).when(ratio <= 0.2, 0.0).when(ratio >= 0.5, 1.0).otherwise((ratio - 0.2) / 0.3)

    # Bound to a variable, so the text is split once.
    density = F.get(F.transform(F.array(F.filter(F.split(text, r"\s+"), lambda x: x != "")), distinct), F.lit(0))
    alnum = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", ""))
    debris = F.rlike(text, F.lit(r"\?{3,}|@{2,}|<0x[0-9A-Fa-f]{2,}>|\\u00[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|\x{FFFD}"))
    clean = F.when(debris | (alnum < 0.5 * n) | (alnum == 0), 0.0).otherwise(1.0)
    language = F.lit(1.0) if confidence is None else confidence
    blank = ~F.rlike(F.coalesce(text, F.lit("")), F.lit(r"\S"))
    return F.when(blank, 0.0).otherwise(0.3 * length + 0.2 * language + 0.2 * density + 0.3 * clean)


#: Words that join parts of a question, weights, the length of short references and the score of a complex question.
CONJUNCTIONS = ("và", "hoặc", "and", "or", "&", "+", "cùng", "with")
COMMA, CONJUNCTION, NUMBER, QUESTION, PER_WORDS, SHORT_REF, COMPLEX = 0.5, 0.4, 0.3, 0.6, 20.0, 80, 1.2
REFERENCE = r"(?U)\b(?i:điều|khoản|điểm|chương|mục|tiết|phần|article|section|clause|chapter|paragraph|part)\s*\.?\s*(?:\d+|[IVXLCDM]+)\b"


def query_complexity(text: Column, conjunctions: tuple[str, ...] = CONJUNCTIONS) -> Column:
    """Weighted commas, conjunctions, numbers, question marks and words; 0 for a short question with one reference to an article, and for null and empty ones."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    conj = F.lit(0)
    for word in conjunctions:
        conj = conj + F.regexp_count(padded, F.lit(f" {re.escape(word)} "))
    n_words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    score = F.greatest(count(",") - 1, F.lit(0)) * COMMA + conj * CONJUNCTION + count(r"(?U)\b\d+\b") * NUMBER + F.greatest(count(r"\?") - 1, F.lit(0)) * QUESTION + n_words / PER_WORDS
    short = (count(REFERENCE) == 1) & (F.length(text) <= SHORT_REF) & (count(",") <= 1) & (conj == 0)
    return F.when((F.coalesce(text, F.lit("")) == "") | short, 0.0).otherwise(score)


def query_is_complex(score: Column, threshold: float = COMPLEX) -> Column:
    """The verdict on a score: complex or simple."""
    return F.when(score >= threshold, "complex").otherwise("simple")


def script_language(text: Column) -> Column:
    """By script, then by letters with marks."""
    has = lambda p: F.rlike(text, F.lit(p))
    return (
        F.when(has("[\\x{3040}-\\x{30FF}]"), "ja").when(has("[\\x{AC00}-\\x{D7AF}]"), "ko").when(has("[\\x{4E00}-\\x{9FFF}]"), "zh").when(has("[\\x{0E00}-\\x{0E7F}]"), "th").when(has("[\\x{0400}-\\x{04FF}]"), "ru").when(has("[\\x{0600}-\\x{06FF}]"), "ar")
        .when(has("[ăâđêôơưĂÂĐÊÔƠƯ\\x{1EA0}-\\x{1EF9}]") & has("[đĐơưƠƯ\\x{1EA0}-\\x{1EF9}]"), "vi").otherwise("latin")
    )


def sentences(text: Column) -> Column:
    """Split after an end mark and white space, but not after common abbreviations."""
    kept = F.regexp_replace(text, r"\b(Dr|Mr|Mrs|Ms|Prof|St|vs|etc|No|Fig)\.\s", "$1 ")
    parts = F.split(kept, r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, "", "."))), lambda s: s != "")


def keywords(text: Column, stop: list[str], least: int = 3) -> Column:
    w = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) >= least))
    return F.array_except(w, F.array(*[F.lit(s) for s in stop]))


def guardrail_hits(texts: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """texts joined with the rules (rule_id, pattern, severity) that match; the rule table is broadcast, so it must stay small."""
    return texts.join(F.broadcast(rules), F.expr(f"{text} RLIKE pattern")).drop("pattern")


def refused(text: Column, template: str, threshold: float = 0.8) -> Column:
    """Whether an answer is the refusal template, or nearly its words."""
    return (F.trim(text) == template.strip()) | (jaccard(F.array_distinct(words(text)), F.array_distinct(words(F.lit(template)))) >= threshold)


def structured_refs(text: Column) -> Column:
    """Article, clause, section, appendix and chapter numbers, as kind:number."""
    kinds = "article|clause|section|appendix|chapter|điều|khoản|mục|phụ lục|chương"
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?:{kinds})\s+(?:\d+|[ivxlc]+)\b"), 0)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\s+(?=\S+$)", ":")))


ROMAN = (("CM", 900), ("CD", 400), ("XC", 90), ("XL", 40), ("IX", 9), ("IV", 4), ("M", 1000), ("D", 500), ("C", 100), ("L", 50), ("X", 10), ("V", 5), ("I", 1))


def roman(number: Column) -> Column:
    """Value of a Roman numeral: pairs that subtract are counted and taken away before single letters."""
    rest, value = F.upper(F.trim(number)), F.lit(0)
    for sign, worth in ROMAN:
        value = value + F.regexp_count(rest, F.lit(sign)) * worth
        rest = F.regexp_replace(rest, sign, "")
    return F.when((rest == "") & (value > 0), value)


def share_link_export(url: Column) -> Column:
    """Export address of a shared sheet or document; other addresses stay."""
    doc = F.regexp_extract(url, r"docs\.google\.com/(spreadsheets|document)/d/([A-Za-z0-9_\-]+)", 2)
    kind = F.regexp_extract(url, r"docs\.google\.com/(spreadsheets|document)/d/([A-Za-z0-9_\-]+)", 1)
    form = F.when(kind == "spreadsheets", "xlsx").otherwise("docx")
    return F.when(doc != "", F.format_string("https://docs.google.com/%s/d/%s/export?format=%s", kind, doc, form)).otherwise(url)


def tolerant_json(text: Column) -> Column:
    """JSON as it stands, without a code fence, with single quotes and trailing commas repaired, or its outermost braces; else null."""
    bare = F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*|\s*```$", "")
    repaired = F.regexp_replace(F.regexp_replace(bare, "'", '"'), r",\s*([}\]])", "$1")
    span = F.regexp_extract(repaired, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.coalesce(*[F.to_json(F.try_parse_json(x)) for x in (text, bare, repaired)], F.to_json(F.try_parse_json(F.when(span != "", span))))


def critique_markers(text: Column) -> Column:
    """[[name: value]] marks of a critique as a map; of equal names the last holds."""
    pairs = F.regexp_extract_all(text, F.lit(r"\[\[\s*[A-Za-z_]+\s*:\s*[^\]]+?\s*\]\]"), 0)
    parts = F.transform(pairs, lambda p: F.struct(F.lower(F.regexp_extract(p, r"\[\[\s*([A-Za-z_]+)", 1)).alias("k"), F.regexp_extract(p, r":\s*([^\]]+?)\s*\]\]", 1).alias("v")))
    last = F.filter(parts, lambda p, i: ~F.exists(F.slice(parts, i + 2, F.size(parts) + 1), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def tool_name(title: str, limit: int = 64, suffix: int = 8) -> str:
    """Identity of a title within a length: longer ones end in a hash of the whole."""
    name = " ".join(title.lower().split())
    return name if len(name) <= limit else name[: limit - suffix - 1] + "-" + hashlib.sha256(name.encode()).hexdigest()[:suffix]
