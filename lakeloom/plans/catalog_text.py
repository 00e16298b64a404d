"""Queries of the catalogue over shaped texts: profiles, orphans, questions, numbers, references, personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import numbers, pii, query_text, text
from lakeloom.operators import chunking, dedup, scope, tables
from lakeloom.plans.catalog import query
from lakeloom.plans.relations import CHUNKS, LOGS, chunks, request_logs, table
from lakeloom.sources.shared import written

# ---- texts with headings, tables, statute parts and code, made of the documents ----


def shaped(spark: SparkSession, sf: str) -> DataFrame:
    """Every document, a sixth each as it stands, under headings, with commas, as a table, as a statute, and with a table of contents and code."""
    k, t = F.col("doc_id") % 6, F.coalesce("text", F.lit(""))
    nl = F.lit("\n")
    shape = (
        F.when(k == 1, F.concat(F.lit("# "), F.replace(t, nl, F.lit("\n## "))))
        .when(k == 2, F.replace(t, F.lit(" "), F.lit(",")))
        .when(k == 3, F.concat(F.lit("| "), F.replace(F.replace(t, nl, F.lit(" |\n| ")), F.lit(" and "), F.lit(" | ")), F.lit(" |")))
        .when(k == 4, F.concat(F.lit("Điều 1. A\nChương II\nMục 3\n"), t))
        .when(k == 5, F.concat(F.lit("Mục lục\n```\n"), t, F.lit("\n```\n$x$ ![i](u)")))
        .otherwise(t)
    )
    return table(spark, sf, "documents").select("doc_id", shape.alias("text"))


SHAPED = """shaped AS (SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN '# ' || replace(t, chr(10), chr(10) || '## ') WHEN 2 THEN replace(t, ' ', ',') WHEN 3 THEN '| ' || replace(replace(t, chr(10), ' |' || chr(10) || '| '), ' and ', ' | ') || ' |'
  WHEN 4 THEN 'Điều 1. A' || chr(10) || 'Chương II' || chr(10) || 'Mục 3' || chr(10) || t WHEN 5 THEN 'Mục lục' || chr(10) || '```' || chr(10) || t || chr(10) || '```' || chr(10) || '$x$ ![i](u)' ELSE t END AS text FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""
PROFILE = rf"""{SHAPED}, bare AS (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS ls FROM shaped),
  ln AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS n FROM bare),
  ki AS (SELECT *, CASE WHEN starts_with(x, '### ') THEN '3' WHEN starts_with(x, '## ') THEN '2' WHEN starts_with(x, '# ') THEN '1' WHEN x = '' THEN 'b'
    WHEN (starts_with(x, '|') AND ends_with(x, '|') AND length(x) - length(replace(x, '|', '')) >= 2) OR regexp_matches(x, '^\|[\s\-:]+\|') OR (length(x) - length(replace(x, '|', '')) >= 2 AND regexp_matches(x, '^[A-ZÀ-Ỹa-zà-ỹ\s]+[|]'))
      OR contains(x, chr(9)) OR regexp_matches(x, '^\d+\s*[|,]\s*\S') OR (contains(x, ',') AND NOT contains(x, '. ') AND NOT regexp_matches(x, '[.;:]$') AND NOT regexp_matches(x, '(?i)^(?:[a-zđ]\)|\([ivxlcdm]+\)|\d+\))\s')) THEN 't' ELSE 'x' END AS kind FROM ln),
  li AS (SELECT doc_id, string_agg(kind, '' ORDER BY n) AS codes, count(*) FILTER (kind = '1') AS h1, count(*) FILTER (kind = '2') AS h2, count(*) FILTER (kind = '3') AS h3, count(*) FILTER (kind = 'x') AS text_blocks,
    CAST(coalesce(sum(len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> ''))) FILTER (kind = 'x'), 0) AS BIGINT) AS total_words, count(*) FILTER (starts_with(x, '```')) AS fences,
    coalesce(bool_or(contains(lower(x), 'mục lục') OR contains(lower(x), 'table of contents') OR regexp_matches(x, '(?:\.\s?){{3,}}\s*\d{{1,4}}\s*$')) FILTER (n <= 30), false) AS has_toc, count(*) FILTER (regexp_matches(x, '(?i)^(?:chương|phần|mục|điều)\s+[ivxlcdm0-9]+')) AS statute_parts FROM ki GROUP BY doc_id),
  fi AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S'))[1:20] AS f FROM shaped), co AS (SELECT doc_id, f, list_transform(f, lambda x: length(x) - length(replace(x, ',', ''))) AS c FROM fi),
  cs AS (SELECT doc_id, len(f) >= 2 AND ((len(list_filter(c, lambda v: v >= 1)) >= 0.6 * len(f) AND len(list_filter(f, lambda x: regexp_matches(x, '[.!?]\s*$'))) <= 0.3 * len(f))
    OR len(list_filter(generate_series(1, len(f) - 4), lambda i: c[i] >= 1 AND len(list_distinct(c[i:i + 4])) = 1)) > 0) AS is_csv_format FROM co),
  pr AS (SELECT doc_id, h1, h2, h3, h1 + h2 + h3 AS total_headings, len(regexp_extract_all(regexp_replace(codes, '[123]', '', 'g'), 't+')) AS table_count, text_blocks, total_words, has_toc, fences, is_csv_format, statute_parts,
    len(regexp_extract_all(text, '\$.*?\$|\\\(.*?\\\)|\\\[.*?\\\]')) AS formula_count, len(regexp_extract_all(text, '!\[.*?\]\(.*?\)|<img\s')) AS image_count, len(regexp_extract_all(text, '(?m)^```')) // 2 AS code_block_count FROM li JOIN cs USING (doc_id) JOIN shaped USING (doc_id)),
  profile AS (SELECT doc_id, h1, h2, h3, total_headings, table_count, total_words, has_toc, is_csv_format, statute_parts, formula_count, image_count, code_block_count, total_words / greatest(text_blocks, 1) AS avg_text_length,
    (table_count + fences) / greatest(total_headings + table_count + text_blocks, 1) AS mixed_content_score, round(total_headings / greatest(total_headings + table_count + formula_count + image_count + code_block_count, 1), 3) AS heading_ratio FROM pr)"""


@query(f"WITH {PROFILE} SELECT * REPLACE (round(avg_text_length, 6) AS avg_text_length, round(mixed_content_score, 6) AS mixed_content_score) FROM profile")
def document_profile(spark, sf):
    rounded = {c: F.round(c, 6) for c in ("avg_text_length", "mixed_content_score")}
    return chunking.profile(shaped(spark, sf)).withColumns(rounded)


@query(f"""WITH {PROFILE}, s AS (SELECT *, round(least(total_headings / 8, 1) * 0.4::DOUBLE + has_toc::INT * 0.35::DOUBLE + (h2 >= 3)::INT * 0.15::DOUBLE + (total_words > 500)::INT * 0.1::DOUBLE, 9) AS a,
    round(least(avg_text_length / 300, 1) * 0.5::DOUBLE + (total_headings <= 3)::INT * 0.25::DOUBLE + (table_count = 0)::INT * 0.15::DOUBLE + (total_words > 1000)::INT * 0.1::DOUBLE, 9) AS b,
    round(0.3::DOUBLE + least(table_count / 3, 1) * 0.35::DOUBLE + (avg_text_length < 50)::INT * 0.2::DOUBLE + (mixed_content_score > 0.2::DOUBLE)::INT * 0.15::DOUBLE, 9) AS c,
    round(least(total_headings / 5, 1) * 0.25::DOUBLE + (mixed_content_score > 0.3::DOUBLE)::INT * 0.25::DOUBLE + (total_words > 2000)::INT * 0.25::DOUBLE + least(avg_text_length / 300, 1) * 0.25::DOUBLE, 9) AS d,
    round(least(avg_text_length / 300, 1) * 0.4::DOUBLE + (total_headings <= 2)::INT * 0.2::DOUBLE + (total_words > 1500)::INT * 0.2::DOUBLE + (table_count = 0)::INT * 0.2::DOUBLE, 9) AS e FROM profile),
  m AS (SELECT *, greatest(a, b, c, d, e) AS best, is_csv_format AND total_headings = 0 AND statute_parts = 0 AS csv, total_headings + statute_parts >= 3 AS law FROM s)
  SELECT doc_id, CASE WHEN csv THEN 'table_csv' WHEN law THEN 'hdt' WHEN best < 0.45::DOUBLE THEN 'recursive' WHEN a = best THEN 'hdt' WHEN b = best THEN 'semantic' WHEN c = best THEN 'recursive' WHEN d = best THEN 'hybrid' ELSE 'proposition' END AS strategy,
    CASE WHEN csv OR law THEN 1.0::DOUBLE WHEN best < 0.45::DOUBLE THEN 0.45::DOUBLE ELSE round(best + 1e-9::DOUBLE, 2) END AS confidence FROM m""")
def strategy_select(spark, sf):
    return chunking.select_strategy(chunking.profile(shaped(spark, sf)))


@query(f"""WITH {CHUNKS}, r AS (SELECT *, length(content) >= 100 AS full_, coalesce(sum(CASE WHEN length(content) >= 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM chunks),
  s AS (SELECT *, sum(length(content) + 1) OVER w - 1 AS size, bool_or(full_) OVER w AS whole, min(chunk_index) OVER w AS low FROM r WINDOW w AS (PARTITION BY doc_id, g)),
  n AS (SELECT *, CASE WHEN whole AND size <= 1024 THEN low ELSE chunk_index END AS name0, CASE WHEN whole THEN CASE WHEN size <= 1024 THEN size ELSE length(content) END END AS own, CASE WHEN whole THEN chunk_index END AS at FROM s),
  l AS (SELECT *, last_value(own IGNORE NULLS) OVER v AS last_size, last_value(CASE WHEN whole THEN name0 END IGNORE NULLS) OVER v AS last_name FROM n WINDOW v AS (PARTITION BY doc_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING)),
  f AS (SELECT doc_id, chunk_index, content, CASE WHEN NOT whole AND last_size + 1 + size <= 1024 THEN last_name ELSE name0 END AS name FROM l)
  SELECT doc_id, name AS chunk_index, count(*) AS merged, string_agg(content, chr(10) ORDER BY chunk_index) AS content FROM f GROUP BY doc_id, name""")
def orphan_merge(spark, sf):
    return chunking.merge_orphans(chunks(spark, sf))


# ---- questions ----


@query(r"""WITH q AS (SELECT conv_id, turn, text, ' ' || lower(text) || ' ' AS p FROM conversations WHERE role = 'user'),
  c AS (SELECT *, len(regexp_extract_all(p, ' và ')) + len(regexp_extract_all(p, ' hoặc ')) + len(regexp_extract_all(p, ' and ')) + len(regexp_extract_all(p, ' or ')) + len(regexp_extract_all(p, ' & ')) + len(regexp_extract_all(p, ' \+ ')) + len(regexp_extract_all(p, ' cùng ')) + len(regexp_extract_all(p, ' with ')) AS conj FROM q),
  s AS (SELECT *, greatest(length(text) - length(replace(text, ',', '')) - 1, 0) * 0.5::DOUBLE + conj * 0.4::DOUBLE + len(regexp_extract_all(text, '\b\d+\b')) * 0.3::DOUBLE + greatest(length(text) - length(replace(text, '?', '')) - 1, 0) * 0.6::DOUBLE
    + len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) / 20 AS sc, len(regexp_extract_all(text, '\b(?i:article|section|clause|chapter|paragraph|part)\s*\.?\s*(?:\d+|[IVXLCDM]+)\b')) = 1 AND length(text) <= 80 AND length(text) - length(replace(text, ',', '')) <= 1 AND conj = 0 AS ref FROM c),
  r AS (SELECT conv_id, turn, CASE WHEN coalesce(text, '') = '' OR ref THEN 0 ELSE sc END AS score FROM s) SELECT conv_id, turn, round(score, 6) AS complexity, CASE WHEN score >= 1.2::DOUBLE THEN 'complex' ELSE 'simple' END AS verdict FROM r""")
def query_complexity(spark, sf):
    score = text.query_complexity(F.col("text"))
    rows = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", score.alias("score"))
    return rows.select("conv_id", "turn", F.round("score", 6).alias("complexity"), text.query_is_complex(F.col("score")).alias("verdict"))


#: Different questions to a part, and the most parts.
QUESTIONS, MOST_PARTS = 2000, 2000


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """A question about each part; what it asks for follows from the part's number."""
    k, name = F.col("p_partkey"), F.col("p_name")
    n = (k % 90 + 10).cast("string")
    q = (
        F.when(k % 8 == 0, F.concat(F.lit("dịch vụ nào dưới "), n, F.lit(" triệu")))
        .when(k % 8 == 1, F.concat(F.lit("liệt kê gói trên "), n, F.lit("k")))
        .when(k % 8 == 2, F.concat(F.lit("từ "), n, F.lit("k đến "), n, F.lit("tr có bao nhiêu loại")))
        .when(k % 8 == 3, F.concat(F.lit("khoảng "), n, F.lit(" triệu")))
        .when(k % 8 == 4, F.concat(F.lit("gói nào "), F.when(k % 16 == 4, "đắt").otherwise("rẻ"), F.lit(" nhất")))
        .when(k % 8 == 5, F.concat(F.lit("Thông tư "), n, F.lit("/2018 thay thế gì?")))
        .when(k % 8 == 6, F.concat(F.lit("liệt kê dịch vụ "), name))
        .otherwise(F.concat(F.lit("lốp "), n, F.lit("/65R"), n, F.lit(" giá bao nhiêu")))
    )
    return table(spark, sf, "part").select("p_partkey", q.alias("question"))


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 1 THEN n * 1000 WHEN 2 THEN n * 1000 WHEN 3 THEN n * 1000000 - n * 100000 END AS price_min, CASE p_partkey % 8 WHEN 0 THEN n * 1000000 WHEN 2 THEN n * 1000000 WHEN 3 THEN n * 1000000 + n * 100000 END AS price_max,
  CASE p_partkey % 8 WHEN 0 THEN 'filter' WHEN 1 THEN 'list' WHEN 2 THEN 'count' WHEN 3 THEN 'list' WHEN 4 THEN CASE WHEN p_partkey % 16 = 4 THEN 'max' ELSE 'min' END END AS operation FROM (SELECT p_partkey, CAST(p_partkey % 90 + 10 AS BIGINT) AS n FROM part)""")
def question_price_ranges(spark, sf):
    """Each different question is read once, in parts of so many however small its table's file is."""
    asked = questions(spark, sf)
    once = written(asked.select("question").distinct(), "questions")
    once = once.repartition(max(1, min(MOST_PARTS, once.count() // QUESTIONS)))
    read = written(once.select("question", query_text.price_range(F.col("question")).alias("r")), "readings")
    rows = asked.join(read, asked["question"].eqNullSafe(read["question"]), "left")
    return rows.select("p_partkey", "r.price_min", "r.price_max", "r.operation")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 8 = 6 THEN p_name END AS listed, CASE WHEN p_partkey % 8 = 7 THEN 'lốp ' || n || '/65R' || n END AS priced, CASE WHEN p_partkey % 8 = 7 THEN n || '/65R' || n END AS code, p_partkey % 8 = 7 AS asks_price
  FROM (SELECT p_partkey, p_name, CAST(p_partkey % 90 + 10 AS VARCHAR) AS n FROM part)""")
def question_entities(spark, sf):
    q = F.col("question")
    rows = questions(spark, sf).withColumn("sixth", F.col("p_partkey") % 8 == 6)
    listed = F.when(F.col("sixth"), query_text.list_of(q)["keyword"])
    return rows.select("p_partkey", listed.alias("listed"), query_text.price_of(q)["keyword"].alias("priced"), query_text.code(q)["keyword"].alias("code"), query_text.asks_price(q).alias("asks_price"))


# ---- numbers, references and other scalars ----


@query("""SELECT o_orderkey, list_filter([CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey + 100000 AS BIGINT) END, CASE WHEN o_orderkey % 3 = 0 THEN CAST(7777777777 AS BIGINT) END], lambda x: x IS NOT NULL) AS grounded_or_not,
  CASE WHEN o_orderkey % 2 = 0 THEN 'grounded' END AS first_kind, CASE WHEN o_orderkey % 3 = 0 THEN 'unsupported' END AS second_kind, 'derived' AS sum_kind FROM orders""")
def number_kinds(spark, sf):
    """Answers that name an order's number, sums of two numbers of the sources, and a number that none has."""
    k = F.col("o_orderkey") + 100000
    rows = table(spark, sf, "orders").select("o_orderkey", F.array(F.concat(F.lit("no. "), k.cast("string")), F.lit("and 20000")).alias("sources"), k.alias("k"))
    answer = F.concat_ws(" ", F.when(F.col("o_orderkey") % 2 == 0, F.col("k").cast("string")), F.when(F.col("o_orderkey") % 3 == 0, F.lit("7777777777")), (F.col("k") + 20000).cast("string"))
    rows = rows.withColumn("kinds", numbers.classify_numbers(answer, F.col("sources")))
    kind = lambda v: F.get(F.transform(F.filter("kinds", lambda x: x["number"] == v), lambda x: x["kind"]), F.lit(0))
    plain = F.transform(F.filter("kinds", lambda x: x["kind"] != "derived"), lambda x: x["number"])
    return rows.select("o_orderkey", plain.alias("grounded_or_not"), kind(F.col("k")).alias("first_kind"), kind(F.lit(7777777777)).alias("second_kind"), kind(F.col("k") + 20000).alias("sum_kind"))


@query("SELECT o_orderkey, [CAST(o_orderkey AS VARCHAR) || '9'] AS missing FROM orders")
def ungrounded_numbers(spark, sf):
    k = F.col("o_orderkey").cast("string")
    return table(spark, sf, "orders").select("o_orderkey", numbers.ungrounded(F.concat(F.lit("total "), k, F.lit("9 of "), k), F.array(F.concat(F.lit("order "), k))).alias("missing"))


@query("SELECT p_partkey, ['điều:' || p_partkey, 'khoản:' || (p_partkey % 9 + 1), 'chapter:iv'] AS refs FROM part")
def structured_references(spark, sf):
    k = F.col("p_partkey")
    t = F.concat(F.lit("Theo Điều "), k.cast("string"), F.lit(", khoản "), (k % 9 + 1).cast("string"), F.lit(" của luật; see Chapter IV, điều "), k.cast("string"))
    return table(spark, sf, "part").select("p_partkey", text.structured_refs(t).alias("refs"))


@query("SELECT p_partkey, p_size AS value FROM part WHERE p_size BETWEEN 1 AND 50")
def roman_numerals(spark, sf):
    """Sizes written in Roman numerals by tens and ones, and read again."""
    tens, ones = F.array(*[F.lit(x) for x in ("", "X", "XX", "XXX", "XL", "L")]), F.array(*[F.lit(x) for x in ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")])
    size = F.col("p_size")
    written = F.concat(F.get(tens, F.floor(size / 10).cast("int")), F.get(ones, size % 10))
    return table(spark, sf, "part").where(size.between(1, 50)).select("p_partkey", text.roman(written).cast("int").alias("value"))


SCRIPTS = {"ja": "カタカナ", "ko": "한국어", "zh": "中文字", "th": "ภาษาไทย", "ru": "русский", "ar": "العربية", "vi": "tiếng Việt đường", "latin": "plain text"}


@query("SELECT p_partkey, list_extract(" + str(list(SCRIPTS)) + ", CAST(p_partkey % 8 + 1 AS INTEGER)) AS script FROM part")
def script_of_text(spark, sf):
    some = F.get(F.array(*[F.lit(x) for x in SCRIPTS.values()]), (F.col("p_partkey") % 8).cast("int"))
    return table(spark, sf, "part").select("p_partkey", text.script_language(F.concat("p_name", F.lit(" "), some)).alias("script"))


@query("SELECT p_partkey, 'giá ' || p_name AS plain FROM part")
def filler_stripping(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.strip_fillers(F.concat(F.lit("dạ cho em hỏi  giá "), "p_name", F.lit(" ạ")), ["dạ", "cho em hỏi", "ạ"]).alias("plain"))


@query("SELECT p_partkey, 'số lượng ' || p_name || ' khách hàng' AS plain FROM part")
def abbreviations(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.expand_abbreviations(F.concat(F.lit("SL "), "p_name", F.lit(" KH")), {"sl": "số lượng", "kh": "khách hàng"}).alias("plain"))


@query("SELECT p_partkey, 'yes' AS grounded, CAST(p_size AS VARCHAR) AS score FROM part")
def critique_marks(spark, sf):
    marks = text.critique_markers(F.concat(F.lit("fine [[grounded: no]] [[Score: "), F.col("p_size").cast("string"), F.lit("]] text [[grounded: yes]]")))
    return table(spark, sf, "part").select("p_partkey", marks["grounded"].alias("grounded"), marks["score"].alias("score"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'https://docs.google.com/spreadsheets/d/k' || p_partkey || '/export?format=xlsx' WHEN 1 THEN 'https://docs.google.com/document/d/k' || p_partkey || '/export?format=docx' ELSE 'https://example.org/k' || p_partkey || '/edit' END AS url FROM part")
def share_links(spark, sf):
    k = F.col("p_partkey")
    base = F.when(k % 3 == 0, "https://docs.google.com/spreadsheets/d/k").when(k % 3 == 1, "https://docs.google.com/document/d/k").otherwise("https://example.org/k")
    return table(spark, sf, "part").select("p_partkey", text.share_link_export(F.concat(base, k.cast("string"), F.lit("/edit"))).alias("url"))


@query(f"WITH {LOGS} SELECT request_id FROM logs WHERE started_at > TIMESTAMP '2024-01-20' - INTERVAL 7 DAYS")
def recent_window(spark, sf):
    return scope.recent(request_logs(spark, sf), "2024-01-20", 7).select("request_id")


@query(f"""WITH {CHUNKS}, s AS (SELECT doc_id, chunk_index, CASE WHEN chunk_index % 5 = 0 THEN '# ' || content ELSE content END AS line FROM chunks),
  m AS (SELECT doc_id, chunk_index AS line_no, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+\\S') THEN trim(regexp_replace(line, '^#{{1,6}}\\s+', ''), ' ') END AS head FROM s)
  SELECT doc_id, line_no, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM m""")
def section_carry_down(spark, sf):
    c = chunks(spark, sf).withColumn("line", F.when(F.col("chunk_index") % 5 == 0, F.concat(F.lit("# "), "content")).otherwise(F.col("content")))
    docs = c.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return chunking.section_of(docs).select("doc_id", "line_no", "section")


@query("SELECT p_partkey AS doc_id, 1 AS blank, 1 AS repeated, true AS has_name, p_partkey % 2 = 0 AS has_price FROM part")
def header_advisory(spark, sf):
    price = F.when(F.col("p_partkey") % 2 == 0, F.lit("Price")).otherwise(F.lit("Note"))
    t = F.concat(F.lit("| Name | "), price, F.lit(" | Note2 | Note2 |  |\n|---|---|---|---|---|\n| "), "p_name", F.lit(" | 5000 | a | b | c |"))
    rows = tables.pipe_rows(table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), t.alias("text")))
    return tables.header_quality(rows).select("doc_id", "blank", "repeated", "has_name", "has_price")


@query("SELECT p_partkey AS doc_id, 'Name: ' || p_name || '; Price: ' || p_size || '.' AS sentence FROM part")
def row_narration(spark, sf):
    t = F.concat(F.lit("| Name | Price |\n|---|---|\n| "), "p_name", F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |"))
    rows = tables.pipe_rows(table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), t.alias("text")))
    return tables.narrate(rows).select("doc_id", "sentence")


@query("SELECT o_orderkey AS answer_id, CAST(o_orderkey + 5000000 AS VARCHAR) AS number FROM orders WHERE o_orderkey % 2 = 1")
def misattributed_numbers(spark, sf):
    """Of two rows the answer names the first; in odd orders it gives the second row's number."""
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders")
    number = lambda some: (k + some).cast("string")
    answers = o.select(k.alias("answer_id"), F.concat(F.lit("alpha costs "), F.when(k % 2 == 1, number(5000000)).otherwise(number(1000000))).alias("text"))
    first = o.select(k.alias("answer_id"), F.lit(1).alias("row_id"), F.concat(F.lit("alpha "), number(1000000)).alias("text"))
    second = o.select(k.alias("answer_id"), F.lit(2).alias("row_id"), F.concat(F.lit("omega "), number(5000000)).alias("text"))
    return numbers.misattributed(answers, first.union(second)).select("answer_id", "number")


@query("SELECT o_orderkey, list_sort(['duration:3 days', 'money:' || (o_orderkey + 1000) || 'k', 'percent:' || (o_orderkey % 100) || '%']) AS claims FROM orders")
def typed_claims(spark, sf):
    k = F.col("o_orderkey")
    t = F.concat(F.lit("down "), (k % 100).cast("string"), F.lit("% in 3 days, at "), (k + 1000).cast("string"), F.lit("k only"))
    found = F.transform(numbers.claims(t), lambda c: F.concat(c["kind"], F.lit(":"), c["claim"]))
    return table(spark, sf, "orders").select("o_orderkey", F.array_sort(found).alias("claims"))


@query("SELECT c_nationkey AS group_id, c_custkey AS place FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) = 1")
def greedy_near_texts(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("group_id"), F.col("c_custkey").alias("place"), F.concat(F.lit("market segment "), "c_mktsegment").alias("text"))
    return dedup.greedy_near(rows, "group_id", 0.95).select("group_id", "place")


# ---- without SQL ----


@query()
def pii_redact(spark, sf):
    return table(spark, sf, "documents").select("doc_id", pii.redact(F.col("text")).alias("redacted"))


@query("SELECT doc_id, nfc_normalize(text) AS plain FROM documents")
def nfc_normalise(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.nfc(F.col("text")).alias("plain"))


@query()
def topic_chunks(spark, sf):
    return chunking.by_topic(table(spark, sf, "documents"))


@query()
def statement_chunks(spark, sf):
    return chunking.by_statement(table(spark, sf, "documents"))


@query()
def strategy_chunks(spark, sf):
    return chunking.by_strategy(shaped(spark, sf))
