"""Chunkers and document profiles: texts are exploded into lines or sentences and put together again by windows, so long documents are only sorted, never held in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType

from lakeloom.functions.text import sentences
from lakeloom.sources.shared import written

DOC = "doc_id"
#: Documents of a batch that are Python objects at once.
AT_ONCE = 100


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line)."""
    return docs.select(DOC, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))


def _ordered(place: str, item: str, joint: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, item))), lambda x: x[item]), joint)


def by_budget(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, chunk_index, content): sentences put together; a new chunk begins with the sentence at which another size characters are full."""
    rows = docs.select(DOC, F.posexplode(sentences(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "))).alias("n", "s"))
    before = F.coalesce(F.sum(F.length("s") + 1).over(Window.partitionBy(DOC).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("bin", F.floor(before / size))
    rows = rows.withColumn("chunk_index", F.dense_rank().over(Window.partitionBy(DOC).orderBy("bin")) - 1)
    return rows.groupBy(DOC, "chunk_index").agg(_ordered("n", "s", " ").alias("content"))


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^(#{1,6})\s+\S", 1))


def by_headings(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, breadcrumb, content): one chunk per heading's section, with the headings above it.

    A heading ends the open headings of its level and below.
    """
    own = Window.partitionBy(DOC).orderBy("line_no")
    rows = lines(docs).withColumn("level", heading_level(F.col("line"))).withColumn("chunk_index", F.sum((F.col("level") > 0).cast("int")).over(own))
    title = F.trim(F.regexp_replace("line", r"^#{1,6}\s+", ""))
    for k in range(1, 7):
        # A heading of this level sets it, one above it clears it.
        mark = F.when(F.col("level") == k, title).when((F.col("level") > 0) & (F.col("level") < k), F.lit(""))
        rows = rows.withColumn(f"h{k}", F.coalesce(F.last(mark, ignorenulls=True).over(own), F.lit("")))
    crumb = F.array_join(F.filter(F.array(*[F.col(f"h{k}") for k in range(1, 7)]), lambda h: h != ""), " > ")
    body = F.when(F.col("level") == 0, F.col("line"))
    out = rows.groupBy(DOC, "chunk_index").agg(F.max(crumb).alias("breadcrumb"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", body.alias("line")))), lambda x: x["line"]), "\n").alias("content"))
    return out.where((F.col("breadcrumb") != "") | (F.trim("content") != ""))


def csv_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, content): each row of a table in text form under its header; a text of one line is a chunk itself."""
    own = Window.partitionBy(DOC).orderBy("line_no")
    rows = lines(docs).where(F.trim("line") != "")
    rows = rows.withColumn("n", F.row_number().over(own)).withColumn("header", F.first("line").over(own)).withColumn("total", F.count("*").over(Window.partitionBy(DOC)))
    content = F.when(F.col("total") == 1, F.trim("line")).otherwise(F.concat("header", F.lit("\n"), "line"))
    return rows.where("n > 1 OR total = 1").select(DOC, F.greatest(F.col("n") - 2, F.lit(0)).alias("chunk_index"), content.alias("content"))


def windows(length: Column, size: int, overlap: int) -> Column:
    """(start, end) of sliding windows over so many characters; an overlap that isn't less than the size gives one window."""
    if not 0 <= overlap < size:
        return F.when(length > 0, F.array(F.struct(F.lit(0).cast("long").alias("start"), length.cast("long").alias("end"))))
    stride = size - overlap
    last = F.greatest(F.ceil((length - size) / stride), F.lit(0))
    span = lambda i: F.struct((i * stride).cast("long").alias("start"), F.least(i * stride + size, length).cast("long").alias("end"))
    return F.when(length > 0, F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), span))


def parent_child(docs: DataFrame, parent: int = 1024, child: int = 256, overlap: int = 50) -> DataFrame:
    """(doc_id, parent_no, child_no, parent_text, content): children overlap within their parent."""
    docs = docs.select(DOC, F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    p = docs.select(DOC, "text", F.posexplode(windows(F.length(text), parent, 0)).alias("parent_no", "w"))
    p = p.select(DOC, "parent_no", F.substring("text", F.col("w.start") + 1, F.col("w.end") - F.col("w.start")).alias("parent_text"))
    c = p.select(DOC, "parent_no", "parent_text", F.posexplode(windows(F.length("parent_text"), child, overlap)).alias("child_no", "w"))
    return c.select(DOC, "parent_no", "child_no", "parent_text", F.substring("parent_text", F.col("w.start") + 1, F.col("w.end") - F.col("w.start")).alias("content"))


def window_of(chunks: DataFrame, size: int, overlap: int) -> DataFrame:
    """Each chunk(chunk_id, start, end, doc_length) with the window that holds most of it, the first at ties."""
    w = chunks.select("*", F.explode(windows(F.col("doc_length"), size, overlap)).alias("w"))
    held = F.greatest(F.least("end", "w.end") - F.greatest("start", "w.start"), F.lit(0))
    return w.groupBy("chunk_id").agg(F.max_by("w", F.struct(held, -F.col("w.start"))).alias("w")).select("chunk_id", "w.start", "w.end")


def merge_orphans(chunks: DataFrame, short: int = 100, most: int = 1024) -> DataFrame:
    """(doc_id, chunk_index, merged, content): short chunks joined to the next one that isn't short, if the whole isn't longer than most.

    Short chunks at the end join the chunk before them under the same bound; whatever doesn't fit stays as it was. A null content is empty.
    """
    own = Window.partitionBy(DOC).orderBy("chunk_index")
    rows = chunks.select(DOC, "chunk_index", F.coalesce("content", F.lit("")).alias("content"))
    full = F.length("content") >= short
    rows = rows.withColumn("full", full).withColumn("g", F.coalesce(F.sum(full.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    group = Window.partitionBy(DOC, "g")
    rows = rows.withColumn("size", F.sum(F.length("content") + 1).over(group) - 1).withColumn("whole", F.max("full").over(group))
    fits = F.col("whole") & (F.col("size") <= most)
    # Where a group is joined its rows get one name, else each keeps its own.
    rows = rows.withColumn("name", F.when(fits, F.min("chunk_index").over(group)).otherwise(F.col("chunk_index")))
    # The tail has no full chunk: it joins the last result before it.
    before = F.last(F.when(F.col("whole"), F.struct("name", F.when(fits, F.col("size")).otherwise(F.length("content")).alias("size"))), ignorenulls=True)
    rows = rows.withColumn("last", before.over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joins = ~F.col("whole") & (F.col("last.size") + 1 + F.col("size") <= most)
    rows = rows.withColumn("name", F.when(joins, F.col("last.name")).otherwise(F.col("name")))
    out = rows.groupBy(DOC, "name").agg(F.count("*").alias("merged"), _ordered("chunk_index", "content", "\n").alias("content"))
    return out.select(DOC, F.col("name").alias("chunk_index"), "merged", "content")


def with_context(chunks: DataFrame, n: int = 1) -> DataFrame:
    """Each chunk with the texts of the n chunks before and after it."""
    own = Window.partitionBy(DOC).orderBy("chunk_index")
    before = F.array_join(F.collect_list("content").over(own.rowsBetween(-n, -1)), " ")
    after = F.array_join(F.collect_list("content").over(own.rowsBetween(1, n)), " ")
    return chunks.withColumn("before", before).withColumn("after", after)


def section_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, section): the last heading at or above each line."""
    own = Window.partitionBy(DOC).orderBy("line_no")
    heading = F.when(heading_level(F.col("line")) > 0, F.trim(F.regexp_replace("line", r"^#{1,6}\s+", "")))
    return lines(docs).withColumn("section", F.last(heading, ignorenulls=True).over(own))


def forward_fill(rows: DataFrame, column: str, *keys: str, order: str) -> DataFrame:
    """Blank cells take the last value above them."""
    own = Window.partitionBy(*keys).orderBy(order)
    value = F.when(F.trim(column) != "", F.col(column))
    return rows.withColumn(column, F.last(value, ignorenulls=True).over(own))


#: Words that begin a numbered part of a statute, lines that end a table of contents' entry, and signs of formulas, images and fences.
PARTS = r"(?iU)^(?:chương|phần|mục|điều)\s+[ivxlcdm0-9]+"
LEADER = r"(?:\.\s?){3,}\s*\d{1,4}\s*$"
FORMULA = r"\$.*?\$|\\\(.*?\\\)|\\\[.*?\\\]"
IMAGE = r"!\[.*?\]\(.*?\)|<img\s"
CLAUSE = r"(?i)^(?:[a-zđ]\)|\([ivxlcdm]+\)|\d+\))\s"
#: Lines looked at for a table of contents and for a table by commas, and the latter's bounds.
TOC_LINES, CSV_LINES, COMMA_SHARE, END_SHARE, CSV_RUN = 30, 20, 0.6, 0.3, 5


def table_line(line: Column) -> Column:
    """Whether a trimmed line is a row of a table: pipes, tabs, a numbered row, or commas without the marks of a sentence or clause."""
    has = lambda p: F.rlike(line, F.lit(p))
    pipes = F.regexp_count(line, F.lit(r"\|"))
    piped = (F.startswith(line, F.lit("|")) & F.endswith(line, F.lit("|")) & (pipes >= 2)) | has(r"^\|[\s\-:]+\|") | ((pipes >= 2) & has(r"^[A-ZÀ-Ỹa-zà-ỹ\s]+[|]"))
    commas = F.contains(line, F.lit(",")) & ~F.contains(line, F.lit(". ")) & ~has(r"[.;:]$") & ~has(CLAUSE)
    return piped | F.contains(line, F.lit("\t")) | has(r"^\d+\s*[|,]\s*\S") | commas


def comma_table(text: Column) -> Column:
    """Whether the first lines are a table by commas: most have one and few end a sentence, or enough in a row have as many."""

    def judge(first: Column) -> Column:
        counts = F.transform(first, lambda x: F.regexp_count(x, F.lit(",")))
        n = F.size(first)
        with_comma = F.size(F.filter(counts, lambda c: c >= 1))
        ends = F.size(F.filter(first, lambda x: F.rlike(x, F.lit(r"[.!?]\s*$"))))
        run = lambda i: (F.get(counts, i) >= 1) & (F.size(F.array_distinct(F.slice(counts, i + 1, CSV_RUN))) == 1)
        alike = F.exists(F.sequence(F.lit(0), F.greatest(n - CSV_RUN, F.lit(0))), run) & (n >= CSV_RUN)
        return (n >= 2) & (((with_comma >= COMMA_SHARE * n) & (ends <= END_SHARE * n)) | alike)

    filled = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"\S")))
    return F.get(F.transform(F.array(F.slice(filled, 1, CSV_LINES)), judge), F.lit(0))


def profile(docs: DataFrame) -> DataFrame:
    """One row of measures per document: headings, tables, words per text line, table of contents, table by commas, statute parts, formulas, images, code.

    Each line is a heading (of level 1 to 3), a row of a table, blank or text. Rows of a table make one table until a text or blank line comes. Words count in text
    lines only. A null text is empty.
    """
    text = F.coalesce("text", F.lit(""))
    bare = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    kind = lambda x: (
        F.when(F.startswith(x, F.lit("### ")), "3").when(F.startswith(x, F.lit("## ")), "2").when(F.startswith(x, F.lit("# ")), "1").when(x == "", "b").when(table_line(x), "t").otherwise("x")
    )
    rows = docs.select(DOC, text.alias("text"), bare.alias("ls")).withColumn("kinds", F.transform("ls", kind))
    codes = F.array_join("kinds", "")
    count = lambda p: F.regexp_count(codes, F.lit(p))
    prose = F.array_join(F.transform(F.filter(F.arrays_zip("ls", "kinds"), lambda z: z["kinds"] == "x"), lambda z: z["ls"]), " ")
    head = F.slice("ls", 1, TOC_LINES)
    toc = F.exists(head, lambda x: F.contains(F.lower(x), F.lit("mục lục")) | F.contains(F.lower(x), F.lit("table of contents")) | F.rlike(x, F.lit(LEADER)))
    fences = F.size(F.filter("ls", lambda x: F.startswith(x, F.lit("```"))))
    rows = rows.select(
        DOC, count("1").alias("h1"), count("2").alias("h2"), count("3").alias("h3"), count("[123]").alias("total_headings"), F.regexp_count(F.regexp_replace(codes, "[123]", ""), F.lit("t+")).alias("table_count"),
        count("x").alias("text_blocks"), F.size(F.filter(F.split(prose, r"\s+"), lambda w: w != "")).alias("total_words"), toc.alias("has_toc"), fences.alias("fences"), comma_table(F.col("text")).alias("is_csv_format"),
        F.size(F.filter("ls", lambda x: F.rlike(x, F.lit(PARTS)))).alias("statute_parts"), F.regexp_count("text", F.lit(FORMULA)).alias("formula_count"), F.regexp_count("text", F.lit(IMAGE)).alias("image_count"),
        F.floor(F.regexp_count("text", F.lit(r"(?m)^```")) / 2).cast("int").alias("code_block_count"),
    )
    blocks = F.col("total_headings") + F.col("table_count") + F.col("text_blocks")
    other = F.col("total_headings") + F.col("table_count") + F.col("formula_count") + F.col("image_count") + F.col("code_block_count")
    rows = rows.withColumn("avg_text_length", F.col("total_words") / F.greatest(F.col("text_blocks"), F.lit(1)))
    rows = rows.withColumn("mixed_content_score", (F.col("table_count") + F.col("fences")) / F.greatest(blocks, F.lit(1)))
    return rows.withColumn("heading_ratio", F.round(F.col("total_headings") / F.greatest(other, F.lit(1)), 3)).drop("fences", "text_blocks")


#: Weights of the strategies' signs.
WEIGHTS = {
    "hdt": {"headings_norm": 0.40, "has_toc": 0.35, "has_h2_group": 0.15, "is_long_doc": 0.10},
    "semantic": {"avg_len_norm": 0.50, "few_headings": 0.25, "no_tables": 0.15, "is_long_doc": 0.10},
    "recursive": {"base": 0.30, "tables_norm": 0.35, "short_avg_len": 0.20, "mixed_content": 0.15},
    "hybrid": {"headings_norm": 0.25, "mixed_content": 0.25, "is_long_doc": 0.25, "avg_len_norm": 0.25},
    "proposition": {"avg_len_norm": 0.40, "few_headings": 0.20, "is_long_doc": 0.20, "no_tables": 0.20},
}
#: What the signs are measured against.
HEADINGS_NORM = {"hdt": 8, "hybrid": 5}
LONG_DOC = {"hdt": 500, "semantic": 1000, "hybrid": 2000, "proposition": 1500}
FEW_HEADINGS = {"semantic": 3, "proposition": 2}
MIXED = {"recursive": 0.2, "hybrid": 0.3}
H2_GROUP, AVG_LEN, TABLES_NORM, SHORT_AVG_LEN, LEAST_SURE, SURE_PARTS = 3, 300, 3, 50, 0.45, 3


def select_strategy(profiles: DataFrame) -> DataFrame:
    """(doc_id, strategy, confidence): the chunking strategy of each profile.

    A table by commas without headings and statute parts is table_csv, enough headings and statute parts are hdt. Else the highest weighted sum of signs wins, of equal ones
    the first; recursive where none is sure enough.
    """
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    capped = lambda c, norm: F.least(F.col(c) / float(norm), F.lit(1.0))
    out = profiles
    for name, weights in WEIGHTS.items():
        sign = {
            "headings_norm": capped("total_headings", HEADINGS_NORM.get(name, 1)), "has_toc": yes(F.col("has_toc")), "has_h2_group": yes(F.col("h2") >= H2_GROUP), "is_long_doc": yes(F.col("total_words") > LONG_DOC.get(name, 0)),
            "avg_len_norm": capped("avg_text_length", AVG_LEN), "few_headings": yes(F.col("total_headings") <= FEW_HEADINGS.get(name, 0)), "no_tables": yes(F.col("table_count") == 0), "base": F.lit(1.0),
            "tables_norm": capped("table_count", TABLES_NORM), "short_avg_len": yes(F.col("avg_text_length") < SHORT_AVG_LEN), "mixed_content": yes(F.col("mixed_content_score") > MIXED.get(name, 0.0)),
        }
        total = F.lit(0.0)
        for k, w in weights.items():
            total = total + sign[k] * w
        out = out.withColumn(f"s_{name}", F.round(total, 9))
    best = F.greatest(*[F.col(f"s_{n}") for n in WEIGHTS])
    table = F.col("is_csv_format") & (F.col("total_headings") == 0) & (F.col("statute_parts") == 0)
    statute = F.col("total_headings") + F.col("statute_parts") >= SURE_PARTS
    pick = F.when(table, "table_csv").when(statute, "hdt").when(best < LEAST_SURE, "recursive")
    for n in WEIGHTS:
        pick = pick.when(F.col(f"s_{n}") == best, n)
    sure = F.when(table | statute, 1.0).when(best < LEAST_SURE, LEAST_SURE).otherwise(F.round(best + 1e-9, 2))
    return out.select(DOC, pick.alias("strategy"), sure.alias("confidence"))


def coverage(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """(doc_id, covered, ratio, gaps) of spans(doc_id, start, end) by the running end of all spans before; touching spans leave no gap."""
    own = Window.partitionBy(DOC).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.withColumn("reach", F.coalesce(F.max("end").over(own), F.lit(0)))
    fresh = F.greatest(F.col("end") - F.greatest("start", "reach"), F.lit(0))
    by = rows.groupBy(DOC).agg(F.sum(fresh).alias("covered"), F.count_if(F.col("start") > F.col("reach")).alias("inner_gaps"), F.max("end").alias("last"))
    out = lengths.join(by, DOC, "left")
    gaps = F.coalesce("inner_gaps", F.lit(0)) + F.when(F.coalesce("last", F.lit(0)) < F.col("length"), 1).otherwise(0)
    return out.select(DOC, F.coalesce("covered", F.lit(0)).alias("covered"), F.round(F.coalesce(F.try_divide(F.coalesce("covered", F.lit(0)).cast("double"), "length"), F.lit(1.0)), 6).alias("ratio"), gaps.alias("gaps"))


#: Weights of letters in order and of shared words in a likeness of sentences, the likeness below which a topic ends, words that join clauses, and the letters of a clause that stands alone.
IN_ORDER, SHARED, TOPIC, CLAUSE_LENGTH = 0.6, 0.4, 0.3, 20
JOINTS = r"(?:;\s*|\s*—\s*|,\s*(?:và|hoặc|nhưng|tuy nhiên|ngoài ra|đồng thời|bên cạnh đó)|,\s*(?:and|or|but|however|moreover|additionally))"


def _shared(a: Column, b: Column) -> Column:
    words = lambda x: F.array_distinct(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    return F.size(F.array_intersect(words(a), words(b))) / F.greatest(F.size(F.array_union(words(a), words(b))), F.lit(1))


def likeness(a: Column, b: Column) -> Column:
    """How alike two sentences are: letters in order and shared words, blended; 0 where one is empty or null."""

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(left, right, strict=True)], dtype="float64")

    low_a, low_b = F.lower(a), F.lower(b)
    blend = IN_ORDER * F.pandas_udf(run, DoubleType())(low_a, low_b) + SHARED * _shared(low_a, low_b)
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).otherwise(F.least(blend, F.lit(1.0)))


def _ratio_is(below: Callable[[float], bool], match: SequenceMatcher, n: int, m: int) -> bool:
    """below(match.ratio()) for a bar below, as soon as what is matched, or what can still be, decides it."""
    todo, sure, open_ = [(0, n, 0, m)], 0, min(n, m)
    while todo:
        a0, a1, b0, b1 = todo.pop()
        open_ -= min(a1 - a0, b1 - b0)
        i, j, k = match.find_longest_match(a0, a1, b0, b1)
        if k:
            sure += k
            for part in ((a0, i, b0, j), (i + k, a1, j + k, b1)):
                if part[0] < part[1] and part[2] < part[3]:
                    todo.append(part)
                    open_ += min(part[1] - part[0], part[3] - part[2])
        if not below(2.0 * sure / (n + m)):
            return False
        if below(2.0 * (sure + open_) / (n + m)):
            return True
    return below(2.0 * sure / (n + m))


def unlike(a: Column, b: Column, least: float) -> Column:
    """Whether the likeness of two sentences is below least. Letters are put in order only where shared words, lengths and counts of letters leave it open."""

    def run(left: pd.Series, right: pd.Series, shared: pd.Series) -> pd.Series:
        out = []
        for x, y, s in zip(left, right, shared, strict=True):
            if not x or not y:
                out.append(least > 0)
                continue
            below = lambda ratio: min(IN_ORDER * ratio + SHARED * s, 1.0) < least  # noqa: B023, E731
            match = SequenceMatcher(None, x, y)
            # Each bound is cheaper than the next; the ratio itself lies between nothing and all of them.
            out.append(below(0.0) and (below(match.real_quick_ratio()) or below(match.quick_ratio()) or _ratio_is(below, match, len(x), len(y))))
        return pd.Series(out, dtype="bool")

    low_a, low_b = F.lower(a), F.lower(b)
    return F.pandas_udf(run, BooleanType())(low_a, low_b, _shared(low_a, low_b))


def _pack(parts: list[str], joint: str, size: int, carry: bool) -> list[str]:
    out, own, n = [], [], 0
    for x in parts:
        if own and n + len(x) > size:
            out.append(joint.join(own))
            own = own[-1:] if carry else []
            n = len(own[0]) if own else 0
        own.append(x)
        n += len(x) + len(joint)
    return [*out, joint.join(own)] if own else out


def packed(parts: Column, joint: str, size: int, carry: bool = False) -> Column:
    """The parts of an array joined to texts: a new one begins where a part would lead beyond size; with carry it begins with the last part of the one before.

    A part longer than size stands alone. One pass over the parts of a row.
    """

    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else _pack(list(r), joint, size, carry) for r in rows], dtype="object")

    return F.pandas_udf(run, ArrayType(StringType()))(parts)


def lines_cut(ls: Column, size: int) -> Column:
    """Lines, those longer than size cut at blanks."""

    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([[p for x in r for p in ([x] if len(x) <= size else _pack(x.split(" "), " ", size, False))] for r in rows], dtype="object")

    return F.pandas_udf(run, ArrayType(StringType()))(ls)


def _numbered(docs: DataFrame, chunks: Column) -> DataFrame:
    return docs.select(DOC, F.posexplode(chunks).alias("chunk_index", "content"))


def by_topic(docs: DataFrame, size: int = 1024, least: float = TOPIC) -> DataFrame:
    """(doc_id, chunk_index, content): runs of sentences, ended where a sentence is less like the next than least; longer runs are cut at blanks.

    Sentences are compared with the one before by a window, so a document's likenesses are taken in parallel batches. Null and blank texts give no chunk.
    """
    rows = docs.select(DOC, F.posexplode(sentences(F.coalesce("text", F.lit("")))).alias("n", "s")).where(F.trim("s") != "")
    own = Window.partitionBy(DOC).orderBy("n")
    rows = rows.withColumn("before", F.lag("s").over(own))
    rows = rows.withColumn("ends", (F.col("before").isNotNull() & unlike(F.col("before"), F.col("s"), least)).cast("int"))
    rows = rows.withColumn("topic", F.sum("ends").over(own))
    runs = rows.groupBy(DOC, "topic").agg(_ordered("n", "s", " ").alias("run"))
    parts = F.when(F.length("run") <= size, F.array("run")).otherwise(packed(F.split("run", " "), " ", size))
    flat = runs.select(DOC, "topic", F.posexplode(parts).alias("part", "content"))
    return flat.withColumn("chunk_index", F.row_number().over(Window.partitionBy(DOC).orderBy("topic", "part")) - 1).select(DOC, "chunk_index", "content")


def _clauses(text: Column) -> Column:
    return F.transform(sentences(F.coalesce(text, F.lit(""))), lambda s: F.filter(F.transform(F.split(s, JOINTS, -1), lambda c: F.trim(c)), lambda c: c != ""))


def statements(text: Column) -> Column:
    """The statements of a text: sentences cut where clauses are joined side by side; a short clause stays with the one before, or the next where it is the first."""

    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([_statements(r) for r in rows], dtype="object")

    return F.pandas_udf(run, ArrayType(StringType()))(_clauses(text))


def _statements(sentences_: list[list[str]]) -> list[str]:
    """A statement begins with each long clause, and with the first clause, to which the first long one of its own sentence still belongs if it is short."""
    out: list[list[str]] = []
    for clauses in sentences_:
        leading = not out
        for c in clauses:
            long = len(c) > CLAUSE_LENGTH
            if not out or (long and not leading):
                out.append([])
            leading = leading and not long
            out[-1].append(c)
    return ["; ".join(x) for x in out]


def by_statement(docs: DataFrame, size: int = 1024, overlap: int = 128) -> DataFrame:
    """(doc_id, chunk_index, content): statements put together up to size; with an overlap a chunk begins with the last statement of the one before."""
    kind = docs.schema[DOC].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # A few documents at once are Python's, and their chunks go on before the next ones come.
            for low in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(low, AT_ONCE)
                made = [_pack(_statements(r), ". ", size, overlap > 0) for r in b.column(1).to_pylist()]
                rows = [i for i, m in enumerate(made) for _ in m]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array([k for m in made for k in range(len(m))], pa.int32()), pa.array([x for m in made for x in m], pa.string())], [DOC, "chunk_index", "content"])

    return docs.select(DOC, _clauses(F.col("text")).alias("clauses")).mapInArrow(cut, f"{DOC} {kind}, chunk_index int, content string")


def by_lines(docs: DataFrame, size: int = 1024) -> DataFrame:
    """(doc_id, chunk_index, content): a document's parts between first-level headings, each cut into tables, kept whole, and other lines packed up to size.

    A table three times as long as size is cut by rows under its header. Lines longer than size are cut at blanks.
    """
    rows = lines(docs).withColumn("bare", F.regexp_replace("line", r"^\s+|\s+$", "")).where("bare <> ''")
    own = Window.partitionBy(DOC).orderBy("line_no")
    rows = rows.withColumn("table", table_line(F.col("bare")) & ~F.startswith(F.col("bare"), F.lit("#")))
    new = F.startswith(F.col("bare"), F.lit("# ")) | (F.col("table") != F.coalesce(F.lag("table").over(own), ~F.col("table")))
    rows = rows.withColumn("block", F.sum(new.cast("int")).over(own))
    blocks = rows.groupBy(DOC, "block").agg(F.first("table").alias("table"), F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("ls"))
    head = F.filter("ls", lambda x, i: (i < 2) | F.rlike(x, F.lit(r"^\s*[|][\s\-:]+[|]")))
    data = F.filter("ls", lambda x, i: (i >= 2) & ~F.rlike(x, F.lit(r"^\s*[|][\s\-:]+[|]")))
    whole, top = F.array_join("ls", "\n"), F.array_join(head, "\n")
    groups = F.transform(packed(data, "\n", size), lambda g: F.concat(top, F.lit("\n"), g))
    parts = F.when(F.col("table"), F.when(F.length(whole) > 3 * size, groups).otherwise(F.array(whole))).otherwise(packed(lines_cut(F.col("ls"), size), "\n", size))
    flat = blocks.select(DOC, "block", F.posexplode(parts).alias("part", "content"))
    return flat.withColumn("chunk_index", F.row_number().over(Window.partitionBy(DOC).orderBy("block", "part")) - 1).select(DOC, "chunk_index", "content")


def by_sections(docs: DataFrame, size: int = 1024, words: int = 300) -> DataFrame:
    """(doc_id, chunk_index, content): a chunk per heading's section under its headings in brackets; sections of more words are cut into statements."""
    parts = by_headings(docs)
    many = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != "")) > words
    cut = F.when(many, packed(statements(F.col("content")), ". ", size, True)).otherwise(F.array("content"))
    lead = F.when(F.col("breadcrumb") != "", F.concat(F.lit("["), "breadcrumb", F.lit("]\n"))).otherwise("")
    flat = parts.select(DOC, F.col("chunk_index").alias("section"), lead.alias("lead"), F.posexplode(cut).alias("part", "text"))
    flat = flat.withColumn("chunk_index", F.row_number().over(Window.partitionBy(DOC).orderBy("section", "part")) - 1)
    return flat.select(DOC, "chunk_index", F.concat("lead", "text").alias("content"))


def by_strategy(docs: DataFrame, size: int = 1024) -> DataFrame:
    """(doc_id, strategy, chunk_index, content): each document cut by the strategy that its profile asks for."""
    # Written once: each way of cutting reads its own documents and not the profiles of all.
    chosen = written(docs.select(DOC, "text").join(select_strategy(profile(docs)).select(DOC, "strategy"), DOC), "strategies")
    cutters = {"table_csv": csv_rows, "hdt": by_sections, "semantic": by_topic, "proposition": by_statement, "hybrid": by_sections, "recursive": by_lines}
    parts = []
    for name, cut in cutters.items():
        own = chosen.where(F.col("strategy") == name).select(DOC, "text")
        made = cut(own) if name == "table_csv" else cut(own, size)
        parts.append(made.select(DOC, F.lit(name).alias("strategy"), F.col("chunk_index").cast("int").alias("chunk_index"), "content"))
    return reduce(DataFrame.unionByName, parts)
